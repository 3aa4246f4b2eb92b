"""Builds small volume images for tests."""

import struct

from mftlake import constants as C

TICKS = 132_223_104_000_000_000  # 2020-01-01


def encode_runs(runs):
    """(clusters, first logical cluster or None) as coded extents."""
    out, at = b"", 0
    for clusters, lcn in runs:
        n = max(1, (clusters.bit_length() + 7) // 8)
        if lcn is None:
            out += bytes([n]) + clusters.to_bytes(n, "little")
        else:
            delta, at = lcn - at, lcn
            w = next(w for w in range(1, 9) if -(1 << 8 * w - 1) <= delta < 1 << 8 * w - 1)
            out += bytes([w << 4 | n]) + clusters.to_bytes(n, "little") + delta.to_bytes(w, "little", signed=True)
    return out + b"\0"


def padded(raw, unit=8):
    return raw + bytes(-len(raw) % unit)


def resident(kind, body, name="", attr_id=0, flags=0):
    named = name.encode("utf-16-le")
    begin = len(padded(bytes(24) + named))
    size = len(padded(bytes(begin) + body))
    head = struct.pack("<IIBBHHHIHBB", kind, size, 0, len(name), 24, flags, attr_id, len(body), begin, 0, 0)
    return padded(padded(head + named) + body)


def non_resident(kind, runs, size, cluster, name="", attr_id=0, flags=0, start_vcn=0, ini=None):
    named, coded = name.encode("utf-16-le"), encode_runs(runs)
    clusters = sum(n for n, _ in runs)
    begin = len(padded(bytes(64) + named))
    total = len(padded(bytes(begin) + coded))
    head = struct.pack("<IIBBHHH", kind, total, 1, len(name), 64, flags, attr_id)
    head += struct.pack("<QQHHIQQQ", start_vcn, start_vcn + clusters - 1, begin, 0, 0, clusters * cluster, size, size if ini is None else ini)
    return padded(padded(head + named) + coded)


def information(permission=0, ticks=TICKS):
    return resident(C.TYPE["STANDARD_INFORMATION"], struct.pack("<QQQQIIII", *[ticks] * 4, permission, 0, 0, 0) + struct.pack("<IIQQ", 7, 8, 9, 10))


def name_body(parent, name, namespace=1, size=0, flags=0, raw=None):
    text = name.encode("utf-16-le") if raw is None else raw
    return struct.pack("<QQQQQQQIIBB", parent | 1 << 48, *[TICKS] * 4, size, size, flags, 0, len(text) // 2, namespace) + text


def file_name(parent, name, **more):
    return resident(C.TYPE["FILE_NAME"], name_body(parent, name, **more))


def index_entry(ref, body, seq=1, sub=None, last=False):
    flags = (C.SUBNODE if sub is not None else 0) | (C.LAST if last else 0)
    size = len(padded(bytes(16) + body)) + (8 if sub is not None else 0)
    raw = struct.pack("<QHHB3x", ref | seq << 48, size, len(body), flags) + body
    return raw.ljust(size - (8 if sub is not None else 0), b"\0") + (struct.pack("<Q", sub) if sub is not None else b"")


def index_root(entries, block, sub=None, kind=C.TYPE["FILE_NAME"]):
    nodes = b"".join(entries) + index_entry(0, b"", sub=sub, last=True)
    body = struct.pack("<IIIB3x", kind, 1, block, 1) + struct.pack("<IIIB3x", 16, 16 + len(nodes), 16 + len(nodes), sub is not None) + nodes
    return resident(C.TYPE["INDEX_ROOT"], body, "$I30")


def protected(raw, sector, number=0x1234):
    """The update sequence applied: the array at the offset the header names, sector ends replaced."""
    out, offset = bytearray(raw), struct.unpack_from("<H", raw, 4)[0]
    struct.pack_into("<H", out, offset, number)
    for i in range(len(raw) // sector):
        end = (i + 1) * sector - 2
        out[offset + 2 + 2 * i : offset + 4 + 2 * i] = out[end : end + 2]
        struct.pack_into("<H", out, end, number)
    return bytes(out)


def index_block(entries, vcn, size, sector):
    nodes = b"".join(entries) + index_entry(0, b"", last=True)
    first = len(padded(bytes(40 + 2 * (size // sector + 1))))
    head = b"INDX" + struct.pack("<HHQQ", 40, size // sector + 1, 0, vcn) + struct.pack("<IIIB3x", first - 24, first - 24 + len(nodes), size - 24, 0)
    return protected((head.ljust(first, b"\0") + nodes).ljust(size, b"\0"), sector)


def record(no, attrs, size, sector, flags=C.IN_USE, seq=1, base=0, end=True):
    first = len(padded(bytes(48 + 2 * (size // sector + 1))))
    body = b"".join(attrs) + (b"\xff\xff\xff\xff" if end else b"")
    head = b"FILE" + struct.pack("<HHQHHHHIIQHHI", 48, size // sector + 1, 77, seq, 1, first, flags, first + len(body), size, base, 0, 0, no)
    raw = (head.ljust(first, b"\0") + body).ljust(size, b"\0")
    assert len(raw) == size, "the record is too small for its attributes"
    return protected(raw, sector)


def code(size, cluster):
    return size // cluster if size >= cluster else 256 - (size.bit_length() - 1)


def boot(sector, cluster, record_size, block, mft_lcn, total):
    raw = bytearray(512)
    raw[3:11] = b"NTFS    "
    struct.pack_into("<HB", raw, 11, sector, cluster // sector)
    struct.pack_into("<QQQ", raw, 40, total, mft_lcn, 2)
    raw[64], raw[68] = code(record_size, cluster), code(block, cluster)
    struct.pack_into("<Q", raw, 72, 99)
    raw[510:512] = b"\x55\xaa"
    return bytes(raw)


class Builder:
    """Clusters are put where they are asked for; the file table lies in two fragments, the second before the first."""

    def __init__(self, sector=512, cluster=1024, record_size=1024, block=4096):
        self.sector, self.cluster, self.record_size, self.block = sector, cluster, record_size, block
        self.records, self.disk, self.free = {}, {}, 4

    def put(self, data, gap=0):
        """Stores bytes in fresh clusters; (clusters, first cluster)."""
        self.free += gap
        at, n = self.free, -(-len(data) // self.cluster)
        self.disk[at] = data
        self.free += n
        return n, at

    def add(self, no, attrs, **more):
        self.records[no] = record(no, attrs, self.record_size, self.sector, **more)

    def raw(self, no, data):
        self.records[no] = data

    def image(self, version=(3, 1), table_in=None):
        """The image's bytes. ``table_in``: the record that the table's second extent stands in, in place of record 0."""
        label = resident(C.TYPE["VOLUME_NAME"], "Täst".encode("utf-16-le"))
        self.add(C.VOLUME, [information(), file_name(C.ROOT, "$Volume"), label, resident(C.TYPE["VOLUME_INFORMATION"], bytes(8) + bytes(version) + bytes(2))])
        count = max(self.records) + 1
        per = max(1, self.record_size // self.cluster)
        first = 16 * self.record_size // self.cluster
        rest = -(-(count - 16) * self.record_size // self.cluster)
        _, low = self.put(bytes(rest * self.cluster))
        _, high = self.put(bytes(first * self.cluster), gap=3)
        runs = [(first, high), (rest, low)]
        size = (first + rest) * self.cluster // self.record_size * self.record_size
        assert per and size
        table = [information(), file_name(C.ROOT, "$MFT"), non_resident(C.TYPE["DATA"], runs, count * self.record_size, self.cluster)]
        if table_in:
            kind = C.TYPE["DATA"]
            item = kind.to_bytes(4, "little") + (32).to_bytes(2, "little") + bytes([0, 26]) + first.to_bytes(8, "little") + (table_in | 1 << 48).to_bytes(8, "little") + bytes(8)
            table = [information(), resident(C.TYPE["ATTRIBUTE_LIST"], item), file_name(C.ROOT, "$MFT"), non_resident(kind, runs[:1], count * self.record_size, self.cluster)]
            self.add(table_in, [non_resident(kind, runs[1:], 0, self.cluster, start_vcn=first)], base=C.MFT)
        self.add(C.MFT, table)
        out = bytearray((self.free + 8) * self.cluster)
        for at, data in self.disk.items():
            out[at * self.cluster : at * self.cluster + len(data)] = data
        for no, raw in self.records.items():
            spot = high * self.cluster + no * self.record_size if no < 16 else low * self.cluster + (no - 16) * self.record_size
            out[spot : spot + self.record_size] = raw
        out[:512] = boot(self.sector, self.cluster, self.record_size, self.block, high, len(out) // self.sector)
        return bytes(out)
