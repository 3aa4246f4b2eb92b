"""Decoders of on-disk structures: bytes in, plain values out, errors as a status. No Spark here."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from mftlake import constants as C


def u(raw: bytes, at: int, width: int) -> int:
    return int.from_bytes(raw[at : at + width], "little")


def utf16(raw: bytes) -> str:
    """Text of UTF-16 code units; lone surrogates, which names may hold, become U+FFFD."""
    return raw.decode("utf-16-le", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


@dataclass(frozen=True)
class Geometry:
    sector_size: int
    cluster_size: int
    record_size: int
    index_block_size: int
    mft_addr: int
    total_sectors: int
    serial: int
    status: str


def _coded_size(code: int, cluster: int) -> int:
    """Clusters if the signed byte is positive, else a power of two."""
    signed = code - 256 if code > 127 else code
    return signed * cluster if signed > 0 else 1 << -signed


def boot(sector: bytes) -> Geometry:
    """Geometry from a boot sector; ``status`` is ``bad_boot`` where signature or sizes make no sense."""
    if len(sector) < 512 or sector[3:11] != b"NTFS    ":
        return Geometry(0, 0, 0, 0, 0, 0, 0, "bad_boot")
    sector_size, per_cluster = u(sector, 11, 2), sector[13]
    # above 128 the count is coded as a negative power of two, as in sizes
    cluster = sector_size * (per_cluster if per_cluster <= 128 else 1 << (256 - per_cluster))
    record, block = _coded_size(sector[64], cluster), _coded_size(sector[68], cluster)
    good = sector_size >= 256 and sector_size & (sector_size - 1) == 0 and cluster > 0 and sector_size <= record <= 1 << 20 and sector_size <= block <= 1 << 24 and sector[510:512] == b"\x55\xaa"
    return Geometry(sector_size, cluster, record, block, u(sector, 48, 8) * cluster, u(sector, 40, 8), u(sector, 72, 8), "ok" if good else "bad_boot")


def fixed_up(block: bytes, sector_size: int, strict: bool = False) -> bytes | None:
    """The block with the last two bytes of every sector restored; None if a sector does not carry the update sequence number.

    Unless ``strict``, a sector that carries its saved bytes already is fine.
    """
    offset, sectors = u(block, 4, 2), len(block) // sector_size
    if offset < 8 or offset + 2 * (sectors + 1) > len(block):
        return None
    number, out = block[offset : offset + 2], bytearray(block)
    for i in range(sectors):
        tail, saved = (i + 1) * sector_size - 2, block[offset + 2 * (i + 1) : offset + 2 * (i + 2)]
        now = block[tail : tail + 2]
        if now != number and (strict or now != saved):
            return None
        out[tail : tail + 2] = saved
    return bytes(out)


@dataclass
class Record:
    record_no: int
    status: str
    fields: dict = field(default_factory=dict)
    raw: bytes = b""


def record(raw: bytes, record_no: int, sector_size: int) -> Record:
    """Header of a file record; ``status``: ok, unreadable, bad_magic or bad_fixup."""
    if len(raw) < 48:
        return Record(record_no, "unreadable")
    if raw[:4] != b"FILE":
        return Record(record_no, "bad_magic")
    patched = fixed_up(raw, sector_size)
    if patched is None:
        return Record(record_no, "bad_fixup")
    lsn, seq, links, first, flags, real, alloc, base = struct.unpack_from("<QHHHHIIQ", patched, 8)
    named = {"lsn": lsn, "seq_no": seq, "hardlinks": links, "attr_offset": first, "flags": flags, "real_size": real, "alloc_size": alloc, "base_ref": base & C.REFERENCE_MASK}
    return Record(record_no, "ok", named, patched)


def attributes(patched: bytes, first: int, mask: int = C.MASK_ALL) -> Iterator[dict]:
    """Attributes of a patched record in the mask, in order. What cannot be read ends the walk with a row of that ``status`` and no type.

    Compressed and encrypted attributes come with status ``unsupported``, as their bytes cannot be read, and those whose runs cannot be decoded
    or hold more clusters than the header says with ``bad_runs``.
    """
    at, order = first, 0
    while at + 4 <= len(patched):
        kind = u(patched, at, 4)
        if kind == C.END_OF_ATTRIBUTES:
            return
        size = u(patched, at + 4, 4)
        if size < 24 or at + size > len(patched):
            yield {"ord": order, "status": "bad_size"}
            return
        head, slot = patched[at : at + size], (kind >> 4) - 1
        if kind & 15 or not 0 <= slot < len(C.ATTRIBUTES):
            yield {"ord": order, "status": "bad_type"}
            return
        if mask >> slot & 1:
            n, place = head[9], u(head, 10, 2)
            resident, flags = head[8] == 0, u(head, 12, 2)
            row = {
                "ord": order,
                "status": "unsupported" if flags & (C.COMPRESSED_ATTRIBUTE | C.ENCRYPTED_ATTRIBUTE) else "ok",
                "type": kind,
                "slot": slot,
                "attr_id": u(head, 14, 2),
                "name": utf16(head[place : place + 2 * n]) if n else "",
                "flags": flags,
                "non_resident": not resident,
                "total_size": size,
            }
            if resident:
                length, begin = u(head, 16, 4), u(head, 20, 2)
                row |= {"body": head[begin : begin + length], "data_size": length}
                if begin + length > size:
                    row["status"] = "bad_body"
            elif size >= 64:
                start, last, runs_at = u(head, 16, 8), u(head, 24, 8), u(head, 32, 2)
                last -= 1 << 64 if last >> 63 else 0  # -1: no cluster
                coded, told = runs(head[runs_at:])
                if told != "ok" or sum(n for n, _ in coded) > last - start + 1:
                    row["status"] = "bad_runs" if row["status"] == "ok" else row["status"]
                row |= {"start_vcn": start, "last_vcn": last, "alloc_size": u(head, 40, 8), "data_size": u(head, 48, 8), "ini_size": u(head, 56, 8), "runs": head[runs_at:]}
            else:
                row["status"] = "bad_body"
            yield row
        at += size
        order += 1


def runs(coded: bytes) -> tuple[list[tuple[int, int]], str]:
    """(clusters, signed offset to the last extent; 0: sparse) of coded extents, and ok or what ended them early."""
    found, at = [], 0
    while at < len(coded) and coded[at]:
        wide, deep = coded[at] & 15, coded[at] >> 4
        if wide > 8 or deep > 8:
            return found, "bad_header"
        if at + 1 + wide + deep > len(coded):
            return found, "truncated"
        clusters = u(coded, at + 1, wide)
        delta = int.from_bytes(coded[at + 1 + wide : at + 1 + wide + deep], "little", signed=True) if deep else 0
        found.append((clusters, delta))
        at += 1 + wide + deep
    return found, "ok"


def placed(coded: list[tuple[int, int]], start_vcn: int = 0) -> list[tuple[int, int, int | None]]:
    """(first virtual cluster, clusters, first logical cluster or None) of extents."""
    out, vcn, lcn = [], start_vcn, 0
    for clusters, delta in coded:
        lcn += delta
        out.append((vcn, clusters, lcn if delta else None))
        vcn += clusters
    return out


def standard_information(body: bytes) -> dict:
    names = ("create_ft", "alter_ft", "mft_ft", "read_ft")
    row = {n: u(body, 8 * i, 8) for i, n in enumerate(names)} | {"permission": u(body, 32, 4)}
    whole = len(body) >= 72
    return row | {"owner_id": u(body, 48, 4) if whole else None, "security_id": u(body, 52, 4) if whole else None, "quota": u(body, 56, 8) if whole else None, "usn": u(body, 64, 8) if whole else None}


def file_name(body: bytes) -> dict | None:
    """Fields of a file name, None where it is cut short."""
    if len(body) < 66 or len(body) < 66 + 2 * body[64]:
        return None
    parent = u(body, 0, 8)
    row = {"parent_ref": parent & C.REFERENCE_MASK, "parent_seq": parent >> 48}
    row |= {n: u(body, 8 * (i + 1), 8) for i, n in enumerate(("create_ft", "alter_ft", "mft_ft", "read_ft", "alloc_size", "real_size"))}
    return row | {"flags": u(body, 56, 4), "namespace": body[65], "name": utf16(body[66 : 66 + 2 * body[64]]), "name_raw": body[66 : 66 + 2 * body[64]]}


def _entries(raw: bytes, at: int, end: int) -> Iterator[dict]:
    order = 0
    while at + 16 <= end:
        ref, size, length, flags = u(raw, at, 8), u(raw, at + 8, 2), u(raw, at + 10, 2), raw[at + 12]
        if size < 16 or at + size > end:
            return
        row = {"ord": order, "file_ref": ref & C.REFERENCE_MASK, "file_seq": ref >> 48, "entry_flags": flags, "sub_vcn": u(raw, at + size - 8, 8) if flags & C.SUBNODE and size >= 24 else None}
        name = file_name(raw[at + 16 : at + 16 + length]) if length else None
        if name:
            yield row | name
        if flags & C.LAST:
            return
        at += size
        order += 1


def index_root(body: bytes) -> Iterator[dict]:
    """Named entries of a root node of a file-name index; other indexes have none."""
    if len(body) >= 32 and u(body, 0, 4) == C.TYPE["FILE_NAME"]:
        yield from _entries(body, 16 + u(body, 16, 4), min(len(body), 16 + u(body, 20, 4)))


def index_block(raw: bytes, sector_size: int) -> tuple[list[dict], str]:
    """Named entries of a block of an index, and its status."""
    if raw[:4] != b"INDX":
        return [], "bad_magic"
    patched = fixed_up(raw, sector_size, strict=True)
    if patched is None:
        return [], "bad_fixup"
    return list(_entries(patched, 24 + u(patched, 24, 4), min(len(patched), 24 + u(patched, 28, 4)))), "ok"


def attribute_list(body: bytes) -> Iterator[dict]:
    """Items of an attribute list, by their offsets on disk."""
    at, order = 0, 0
    while at + 26 <= len(body):
        size, ref = u(body, at + 4, 2), u(body, at + 16, 8)
        if size < 26:
            return
        n, place = body[at + 6], body[at + 7]
        yield {"ord": order, "type": u(body, at, 4), "slot": (u(body, at, 4) >> 4) - 1, "name": utf16(body[at + place : at + place + 2 * n]), "start_vcn": u(body, at + 8, 8), "target_ref": ref & C.REFERENCE_MASK, "target_seq": ref >> 48, "attr_id": u(body, at + 24, 2)}
        at += size
        order += 1


@dataclass(frozen=True)
class Volume:
    """What a scan must know of an image. ``extents``: (first record, records, byte address) of the file table."""

    image: str
    geometry: Geometry
    records: int
    extents: tuple[tuple[int, int, int], ...]
    version: tuple[int, int]
    name: str
    status: str


def _own_list(table: Record, read: Callable[[int, int], bytes], cluster: int) -> Iterator[dict]:
    """Items of a record's attribute list, wherever its bytes are."""
    for a in attributes(table.raw, table.fields["attr_offset"]):
        if a.get("slot") == 1 and a["status"] == "ok":
            parts = [] if not a["non_resident"] else placed(runs(a["runs"])[0], a["start_vcn"])
            data = b"".join(read(lcn * cluster, n * cluster) for _, n, lcn in parts if lcn is not None)[: a["data_size"]]
            yield from attribute_list(data if a["non_resident"] else a["body"])


def volume(image: str, read: Callable[[int, int], bytes]) -> Volume:
    """Bootstraps an image through ``read(address, length)``: boot sector, record 0 and its extents, record 3 and its version.

    ``status``: ok, bad_boot, bad_mft (the table cannot be read), bad_version (before 3) or partial_mft (some of its extents cannot be found;
    records beyond those that can are not scanned).
    """
    g = boot(read(0, 512))
    if g.status != "ok":
        return Volume(image, g, 0, (), (0, 0), "", g.status)

    def at(no: int) -> Record:
        return record(read(g.mft_addr + no * g.record_size, g.record_size), no, g.sector_size)

    table = at(C.MFT)
    own = [] if table.status != "ok" else [a for a in attributes(table.raw, table.fields["attr_offset"]) if a.get("slot") == 7 and a["status"] == "ok" and a["non_resident"] and not a["name"]]
    if not own:
        return Volume(image, g, 0, (), (0, 0), "", "bad_mft")
    extents, size = [], max(a["data_size"] for a in own)

    def spread(found: list[dict]) -> None:
        for a in found:
            for vcn, clusters, lcn in placed(runs(a["runs"])[0], a["start_vcn"]):
                if lcn is not None:
                    first, end = vcn * g.cluster_size // g.record_size, (vcn + clusters) * g.cluster_size // g.record_size
                    extents.append((first, end - first, lcn * g.cluster_size))

    spread(own)
    # the rest of a table in many pieces stands in records that the list of record 0 names, each within the pieces before
    waiting = {i["target_ref"] for i in _own_list(table, read, g.cluster_size) if i["slot"] == 7 and not i["name"]} - {C.MFT}
    while reached := [(no, address + (no - first) * g.record_size) for no in sorted(waiting) for first, count, address in extents if first <= no < first + count]:
        for no, address in reached:
            waiting.discard(no)
            more = record(read(address, g.record_size), no, g.sector_size)
            if more.status == "ok":
                spread([a for a in attributes(more.raw, more.fields["attr_offset"]) if a.get("slot") == 7 and a["status"] == "ok" and a["non_resident"] and not a["name"]])
    extents.sort()
    whole = sum(count for _, count, _ in extents) >= size // g.record_size
    records = size // g.record_size
    major = minor = 0
    label = ""
    info = at(C.VOLUME)
    if info.status == "ok":
        for a in attributes(info.raw, info.fields["attr_offset"]):
            if a.get("type") == C.TYPE["VOLUME_INFORMATION"] and len(a.get("body", b"")) >= 10:
                major, minor = a["body"][8], a["body"][9]
            if a.get("type") == C.TYPE["VOLUME_NAME"]:
                label = utf16(a.get("body", b""))
    return Volume(image, g, records, tuple(extents), (major, minor), label, "bad_version" if major < 3 else "ok" if whole else "partial_mft")
