"""Column functions over decoded or raw values; all of them native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mftlake import constants as C


def le_uint(raw: Column, offset: int, width: int) -> Column:
    """Unsigned little-endian integer of up to 7 bytes at ``offset`` (from 0) of a binary; null where it is too short."""
    octets = [F.hex(F.substring(raw, offset + i + 1, 1)) for i in reversed(range(width))]
    value = F.conv(F.concat(*octets), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(raw) >= offset + width, value if width > 7 else value.cast("bigint"))


def le_bytes(value: Column, width: int) -> Column:
    """The little-endian binary of a non-negative integer."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def sign_extend(value: Column, width: int) -> Column:
    """The signed reading of an unsigned integer of ``width`` bytes."""
    return F.when(value >= F.lit(1 << (8 * width - 1)), value - F.lit(1 << (8 * width))).otherwise(value)


def reference(value: Column) -> Column:
    """Record number in a file reference."""
    return value.bitwiseAND(F.lit(C.REFERENCE_MASK))


def reference_sequence(value: Column) -> Column:
    return F.shiftrightunsigned(value, 48).cast("int")


def size_code(code: Column, cluster_size: Column) -> Column:
    """Bytes of a record or index block: that many clusters if the signed code is positive, else two to its negative."""
    return F.when(code > 0, code.cast("bigint") * cluster_size.cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), -code.cast("int")))


def slot(attribute_type: Column) -> Column:
    return (F.shiftright(attribute_type, 4) - 1).cast("int")


def mask_bit(slot_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), slot_.cast("int"))


def in_mask(slot_: Column, mask: int) -> Column:
    return mask_bit(slot_).bitwiseAND(F.lit(mask).cast("bigint")) != 0


def attribute_label(slot_: Column, name: Column) -> Column:
    """Display name of an attribute type, the attribute's own name in parentheses."""
    label = F.element_at(F.array(*(F.lit(a) for a in C.ATTRIBUTES)), slot_ + 1)
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(label, F.lit(" ("), name, F.lit(")"))).otherwise(label)


def has_flag(flags: Column, bit: int) -> Column:
    """Whether the bit is set; false for null, as where there is no such attribute."""
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def is_deleted(record_flags: Column) -> Column:
    return ~has_flag(record_flags, C.IN_USE)


def is_directory(record_flags: Column) -> Column:
    return has_flag(record_flags, C.IS_DIRECTORY)


def rhs(flags: Column) -> Column:
    """Read-only, hidden and system as ``RHS``, blanks where they are not set."""
    return F.concat(*(F.when(has_flag(flags, bit), F.lit(c)).otherwise(F.lit(" ")) for bit, c in ((C.READONLY, "R"), (C.HIDDEN, "H"), (C.SYSTEM, "S"))))


def is_win32_name(name: Column, namespace: Column) -> Column:
    return F.coalesce((namespace != C.DOS) & (name != ""), F.lit(False))


def same_name(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def matches_whole(name: Column, pattern: str | None) -> Column:
    """Whether a regular expression matches the whole name, cases told apart; none or blanks stand for any name."""
    return name.rlike(f"^(?:{(pattern or '').strip() or '.*'})$")


def filetime(ts: Column) -> Column:
    """Ticks of 100 ns since 1601 of a time in UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(C.EPOCH_TICKS)


def from_filetime(ticks: Column) -> Column:
    """The time in UTC, to the microsecond."""
    return F.timestamp_micros(F.floor(((ticks - F.lit(C.EPOCH_TICKS)).cast("decimal(20,0)") / 10)).cast("bigint"))


def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd  HH:mm")


def path_parts(path: Column) -> Column:
    """Components of ``X:\\a\\b``; quotes and blanks around it are tolerated, the root has none."""
    bare = F.regexp_replace(F.regexp_replace(path, r'^["\s]*[A-Za-z]\s*:[^\\]*\\*', ""), r'["\\\s]+$', "")
    return F.filter(F.split(bare, r"\\+"), lambda p: p != "")


#: more bytes than any binary has
WHOLE = (1 << 31) - 1


def path_volume(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, r'^["\s]*([A-Za-z])\s*:', 1))


def line_offsets(raw: Column, limit: int = 16_384, width: int = 16) -> Column:
    """Where the hex lines of the first ``limit`` bytes begin; none for an empty binary."""
    n = F.least(F.octet_length(raw), F.lit(limit))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))


def hex_line(raw: Column, at: Column, limit: int = 16_384, width: int = 16) -> tuple[Column, Column, Column]:
    """(offset, hex, ascii) of the line of a hex dump that begins at ``at``.

    Offsets have four digits at least, a dash parts the halves of a line, bytes outside printable ASCII are dots, and
    a short last line is padded by FF.
    """
    part = F.substring(raw, at + 1, F.least(F.lit(width), F.lit(limit) - at))
    digits = F.rpad(F.hex(part), 2 * width, "F")
    spaced = lambda s: F.rtrim(F.regexp_replace(s, "(..)", "$1 "))
    text = F.concat(spaced(F.substring(digits, 1, width)), F.lit(" - "), spaced(F.substring(digits, width + 1, width)))
    letters = F.rpad(F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", "."), width, ".")
    return F.when(at <= 0xFFFF, F.lpad(F.hex(at), 4, "0")).otherwise(F.hex(at)), text, letters


def hex_lines(raw: Column, limit: int = 16_384, width: int = 16) -> Column:
    """Array of the hex lines (offset, hex, ascii) of the first ``limit`` bytes."""

    def line(at: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(hex_line(raw, at, limit, width), ("offset", "hex", "ascii"))))

    return F.transform(line_offsets(raw, limit, width), line)


def attribute_hex_lines(raw: Column, width: int = 16) -> Column:
    """Array of the hex lines (hex, ascii) of an attribute's bytes, all of them; a last line of half a line or less shows its first half only."""

    def line(at: Column) -> Column:
        _, text, letters = hex_line(raw, at, WHOLE, width)
        half = F.octet_length(raw) - at <= width // 2
        return F.struct(F.when(half, F.substring(text, 1, 3 * (width // 2) - 1)).otherwise(text).alias("hex"), F.when(half, F.substring(letters, 1, width // 2)).otherwise(letters).alias("ascii"))

    return F.transform(line_offsets(raw, WHOLE, width), line)


def slice_bytes(raw: Column, offset: Column, length: Column) -> Column:
    """Bytes of a byte range, clamped to the end; null if it starts beyond it."""
    return F.when((offset >= 0) & (offset <= F.octet_length(raw)) & (length >= 0), F.substring(raw, (offset + 1).cast("int"), length.cast("int")))


def cluster_free(byte: Column, cluster: Column) -> Column:
    """Whether a cluster's bit is clear in its byte of the bitmap; beyond the bitmap all is free."""
    bit = F.call_function("shiftright", byte.cast("int"), F.pmod(cluster, F.lit(8)).cast("int")).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 0, F.lit(True))
