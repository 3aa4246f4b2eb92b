import pytest
from pyspark.sql import functions as F

from image_builder import Builder, encode_runs, file_name, index_block, index_entry, index_root, information, name_body, non_resident, record, resident
from mftlake import constants as C
from mftlake.operators import attributes as A
from mftlake.operators import streams as S
from mftlake.operators import tree as T
from mftlake.sources import decode as D
from mftlake.sources import sinks
from mftlake.sources.relations import Image

DIR, DATA = C.IN_USE | C.IS_DIRECTORY, C.TYPE["DATA"]


def populated(**geometry):
    """Root: dir "Docs" (20), files; Docs holds big.bin (21), sub dir (22); names in a root node and in blocks."""
    b = Builder(**geometry)
    c = b.cluster
    big = bytes(i * 7 % 256 for i in range(5 * c + 13))
    n1, at1 = b.put(big[: 2 * c])
    n2, at2 = b.put(big[2 * c :], gap=5)
    holes = [(1, b.put(b"A" * c)[1]), (3, None), (1, b.put(b"B" * c)[1])]
    entries = [index_entry(20, name_body(C.ROOT, "Docs", flags=C.NAME_DIRECTORY)), index_entry(24, name_body(C.ROOT, "small.txt", size=5))]
    b.add(C.ROOT, [information(), file_name(C.ROOT, "."), index_root([index_entry(C.ROOT, name_body(C.ROOT, ".", flags=C.NAME_DIRECTORY)), *entries], b.block)], flags=DIR)
    inner = [index_entry(21, name_body(20, "big.bin", size=len(big))), index_entry(22, name_body(20, "Sub", flags=C.NAME_DIRECTORY)), index_entry(23, name_body(20, "SPARSE~1", namespace=2)), index_entry(23, name_body(20, "sparse file"))]
    step = max(1, b.block // c)
    blocks = index_block(inner[:2], 0, b.block, b.sector) + b"BAD!" + bytes(b.block - 4) + index_block(inner[2:], 2 * step, b.block, b.sector)
    m, at = b.put(blocks)
    b.add(20, [information(), file_name(C.ROOT, "Docs"), index_root([], b.block, sub=0), non_resident(C.TYPE["INDEX_ALLOCATION"], [(m, at)], len(blocks), c, "$I30")], flags=DIR)
    b.add(21, [information(C.READONLY), file_name(20, "big.bin", size=len(big)), non_resident(DATA, [(n1, at1), (n2, at2)], len(big), c), resident(DATA, b"other", "ads")])
    b.add(22, [information(), file_name(20, "Sub"), index_root([index_entry(25, name_body(22, "deep"))], b.block)], flags=DIR)
    b.add(23, [information(C.HIDDEN | C.SPARSE), file_name(20, "SPARSE~1", namespace=2), file_name(20, "sparse file"), non_resident(DATA, holes, 5 * c - 10, c, ini=4 * c + 4)])
    b.add(24, [information(), file_name(C.ROOT, "small.txt", size=5), resident(DATA, b"hello")])
    # a file whose stream continues in extension record 27, which the list names twice
    p, q = b.put(b"x" * c), b.put(b"y" * c, gap=2)
    item = lambda ref, vcn, i: DATA.to_bytes(4, "little") + (32).to_bytes(2, "little") + bytes([0, 26]) + vcn.to_bytes(8, "little") + (ref | 1 << 48).to_bytes(8, "little") + i.to_bytes(2, "little") + bytes(6)
    b.add(25, [information(), resident(C.TYPE["ATTRIBUTE_LIST"], item(25, 0, 0) + item(27, 1, 1) + item(27, 1, 1)), file_name(22, "deep"), non_resident(DATA, [p], 2 * c, c)])
    b.add(27, [non_resident(DATA, [q], 0, c, attr_id=1, start_vcn=1)], base=25)
    # and one whose stream continues in two extension records, in each at the same place
    r, t, v = b.put(b"r" * c, gap=1), b.put(b"s" * c, gap=3), b.put(b"t" * c, gap=2)
    b.add(31, [information(), resident(C.TYPE["ATTRIBUTE_LIST"], item(31, 0, 0) + item(32, 1, 0) + item(33, 2, 0)), file_name(22, "deep 2"), non_resident(DATA, [r], 3 * c - 7, c)])
    b.add(32, [non_resident(DATA, [t], 0, c, start_vcn=1)], base=31)
    b.add(33, [non_resident(DATA, [v], 0, c, start_vcn=2)], base=31)
    b.add(26, [information(), file_name(99, "gone"), resident(DATA, b"deleted")], flags=0)
    b.raw(28, b"BAAD" + bytes(b.record_size - 4))
    broken = bytearray(record(29, [information()], b.record_size, b.sector))
    broken[b.sector - 2 : b.sector] = b"\x99\x99"
    b.raw(29, bytes(broken))
    b.add(30, [information(), file_name(C.ROOT, "packed"), non_resident(DATA, [(1, 5)], 10, c, flags=C.COMPRESSED_ATTRIBUTE)])
    bits = bytes([0b00000101, 0xFF, 0])
    b.add(C.BITMAP_FILE, [information(), file_name(C.ROOT, "$Bitmap"), resident(DATA, bits)])
    return b, big


@pytest.fixture(scope="module", params=[{}, {"cluster": 4096, "record_size": 4096}, {"cluster": 512, "block": 1024}])
def image(request, spark, tmp_path_factory):
    b, big = populated(**request.param)
    path = tmp_path_factory.mktemp("images") / "one.img"
    path.write_bytes(b.image())
    return Image(spark, str(path), records_per_partition=7), b, big


def test_volume(image):
    it, b, _ = image
    v = it.volumes().first()
    assert (v["ok"], v["ver_major"], v["ver_minor"], v["volume_name"], v["records"]) == (True, 3, 1, "Täst", 34)
    assert (v["sector_size"], v["cluster_size"], v["record_size"], v["index_block_size"]) == (b.sector, b.cluster, b.record_size, b.block)


def test_records_and_status(image):
    it, *_ = image
    got = {r["record_no"]: r for r in it.records().collect()}
    assert len(got) == 34
    assert (got[20]["is_dir"], got[26]["in_use"], got[27]["base_ref"]) == (True, False, 25)
    assert (got[28]["status"], got[29]["status"], got[21]["status"]) == ("bad_magic", "bad_fixup", "ok")
    assert {r["record_no"] for r in it.records(F.col("record_no").isin(21, 24)).collect()} == {21, 24}


def test_scan_is_pruned(image):
    it, *_ = image
    assert it.raw().rdd.getNumPartitions() == 5
    assert it.raw(F.col("record_no") == 24).rdd.getNumPartitions() == 1
    assert it.raw((F.col("record_no") >= 7) & (F.col("record_no") < 14)).rdd.getNumPartitions() == 1


def test_listing_and_paths(image, spark):
    it, *_ = image
    entries = it.entries(it.attributes()).cache()
    listed = {(r["dir_ref"], r["name"]) for r in T.list_directory(entries).collect()}
    assert listed == {(5, "Docs"), (5, "small.txt"), (20, "big.bin"), (20, "Sub"), (20, "sparse file"), (22, "deep")}
    paths = spark.createDataFrame([(it.path, p) for p in (r'"C:\docs\SUB\deep"', "C:\\", r"c:\Docs\none", r"C:\small.txt\x", r"D:\DOCS\big.bin")], "image string, path string")
    assert [r["ref"] for r in sorted(T.resolve_paths(entries, paths, 4).collect(), key=lambda r: r["path"])] == [25, 5, None, 21, None]
    counts = {r["dir_ref"]: (r["files"], r["directories"]) for r in T.count_entries(entries).collect()}
    assert counts == {5: (1, 1), 20: (2, 1), 22: (1, 0)}


def test_search(image):
    it, *_ = image
    nodes = it.nodes(it.attributes()).cache()
    got = {r["ref"]: r for r in T.search(nodes, "[a-z ]+|gone", 8).collect()}
    assert {k: r["path"] for k, r in got.items()} == {23: ".\\Docs\\sparse file", 25: ".\\Docs\\Sub\\deep", 26: "gone", 30: "packed"}
    assert got[25]["time"] == "2020-01-01  00:00"
    assert [r["ref"] for r in T.search(nodes, " ", 8, limit=2, state=~F.col("in_use")).collect()] == [26]


def test_streams(image):
    it, b, big = image
    attributes = it.attributes().cache()
    whole = {(r["record_no"], r["name"]): bytes(r["bytes"]) for r in it.stream_bytes(attributes.filter("slot = 7")).collect()}
    c = b.cluster
    assert whole[21, ""] == big and whole[21, "ads"] == b"other" and whole[24, ""] == b"hello"
    sparse = (b"A" * c + bytes(3 * c) + b"B" * c)[: 5 * c - 10]
    assert whole[23, ""] == sparse[: 4 * c + 4] + bytes(len(sparse) - 4 * c - 4)
    assert whole[25, ""] == b"x" * c + b"y" * c
    assert whole[31, ""] == b"r" * c + b"s" * c + b"t" * (c - 7)
    assert (30, "") not in whole
    found = S.find_stream(attributes, "ads").collect()
    assert [(r["record_no"], bytes(r["body"])) for r in found] == [(21, b"other")]


def test_recover(image, tmp_path):
    it, _, big = image
    chunks = it.stream_chunks(it.attributes().filter("slot = 7 and record_no in (21, 24)"))
    out = {r["name"]: (r["path"], r["n_bytes"]) for r in sinks.recover_files(chunks.filter("record_no = 21"), str(tmp_path / "out")).collect()}
    assert open(out[""][0], "rb").read() == big and out["ads"][1] == 5
    kinds = it.stream_chunks(it.attributes().filter("record_no = 21 and not non_resident"))
    names = {r["path"].rpartition("-")[2] for r in sinks.recover_files(kinds, str(tmp_path / "kinds")).collect()}
    assert names == {"21.STANDARD_INFORMATION", "21.FILE_NAME", "21.ads"}
    sinks.recover_table(chunks, str(tmp_path / "table"))
    assert sinks.large(chunks, over=100).count() == 1


def test_table_extents_in_an_extension_record(spark, tmp_path):
    b, big = populated()
    path = tmp_path / "split.img"
    path.write_bytes(b.image(table_in=14))
    it = Image(spark, str(path), records_per_partition=7)
    assert [v.status for v in it.found.values()] == ["ok"]
    assert {bytes(r["bytes"]) for r in it.stream_bytes(it.attributes().filter("slot = 7 and record_no = 21 and name = ''")).collect()} == {big}
    b, _ = populated()
    path.write_bytes(b.image(table_in=20))  # within the extent that it should tell
    it = Image(spark, str(path))
    assert [v.status for v in it.found.values()] == ["partial_mft"] and it.records().filter("status = 'ok'").agg(F.max("record_no")).first()[0] < 16


def test_runs_beyond_the_header_are_refused():
    good = record(0, [non_resident(DATA, [(2, 5)], 10, 1024)], 1024, 512)
    from mftlake.sources import decode as D

    def status(raw):
        found = D.record(raw, 0, 512)
        return [a["status"] for a in D.attributes(found.raw, found.fields["attr_offset"])]

    attribute = bytearray(non_resident(DATA, [(2, 5)], 10, 1024))
    attribute[24:32] = bytes(8)  # last cluster 0: one cluster only
    broken = bytearray(non_resident(DATA, [(2, 5)], 10, 1024))
    broken[64] = 0x99
    assert status(good) == ["ok"] and status(record(0, [bytes(attribute)], 1024, 512)) == ["bad_runs"] and status(record(0, [bytes(broken)], 1024, 512)) == ["bad_runs"]


def test_attributes_and_bitmap(image):
    it, *_ = image
    attributes = it.attributes().cache()
    assert {(r["record_no"], r["src_record_no"]) for r in attributes.filter("slot = 7 and record_no in (25, 27)").collect()} == {(25, 25), (25, 27), (27, 27)}
    assert attributes.filter("record_no = 25 and src_record_no = 27").count() == 1
    masked = it.own_attributes(mask=1 << 7).select("slot").distinct().collect()
    assert {r["slot"] for r in masked} == {0, 1, 7}
    flags = {r["record_no"]: r for r in A.record_flags(it.records().filter("status = 'ok'"), it.standard_information(attributes)).collect()}
    assert flags[21]["read_only"] and flags[23]["hidden"] and flags[23]["sparse"] and not flags[24]["hidden"] and flags[26]["deleted"]
    bitmap = it.bitmap(attributes)
    wanted = bitmap.sparkSession.createDataFrame([(it.path, n) for n in (0, 1, 2, 8, 16, 999)], "image string, cluster long")
    assert {r["cluster"]: r["free"] for r in S.clusters_free(wanted, bitmap).collect()} == {0: False, 1: True, 2: False, 8: False, 16: True, 999: True}
    assert S.free_space(bitmap, 512).first()["free_clusters"] == 14
    lines = A.dump(attributes.filter("record_no = 24")).orderBy("slot", "line_no").collect()
    assert lines[-1]["hex"].startswith("68 65 6C 6C 6F FF") and lines[-1]["ascii"] == "hello..........."


def test_bad_volumes(spark, tmp_path):
    b, _ = populated()
    (tmp_path / "a.img").write_bytes(b.image(version=(1, 2)))
    good = populated()[0].image()
    (tmp_path / "b.img").write_bytes(good[:3] + b"FAT32   " + good[11:])
    (tmp_path / "c.img").write_bytes(b"")
    it = Image(spark, str(tmp_path / "*.img"))
    assert [r["status"] for r in it.volumes().orderBy("image").collect()] == ["bad_version", "bad_boot", "bad_boot"]
    assert it.raw().count() == 0


def test_run_decoding():
    cases = [[], [(1, 5)], [(3, 100), (2, 50), (4, None), (1, 51)], [(1 << 40, 1 << 45), (2, 3)]]
    for runs in cases:
        coded, status = D.runs(encode_runs(runs))
        assert status == "ok"
        assert [(n, lcn) for _, n, lcn in D.placed(coded)] == runs
    assert D.runs(b"\x19" + bytes(12)) == ([], "bad_header")
    assert D.runs(b"\x11\x01") == ([], "truncated")


def test_fixup_rules():
    raw = record(1, [information()], 1024, 512)
    assert D.record(raw, 1, 512).status == "ok"
    done = D.fixed_up(raw, 512)
    again = raw[:510] + done[510:512] + raw[512:]
    assert D.fixed_up(again, 512) == done
    other = bytearray(raw)
    other[50:52] = b"\x07\x07"  # saved bytes differ from what the sector carries
    broken = bytes(other[:510]) + b"\x07\x07" + bytes(other[512:])
    assert D.fixed_up(broken, 512) is not None and D.fixed_up(broken, 512, strict=True) is None


def test_attribute_walk_errors():
    good = D.record(record(1, [information(), resident(DATA, b"x")], 1024, 512), 1, 512)
    first = good.fields["attr_offset"]
    assert [a["status"] for a in D.attributes(good.raw, first)] == ["ok", "ok"]
    zero = bytearray(good.raw)
    zero[first + 4 : first + 8] = bytes(4)
    assert [a["status"] for a in D.attributes(bytes(zero), first)] == ["bad_size"]
    odd = bytearray(good.raw)
    odd[first : first + 4] = (0x110).to_bytes(4, "little")
    assert [a["status"] for a in D.attributes(bytes(odd), first)] == ["bad_type"]


def test_names():
    lone = D.file_name(name_body(5, "", raw=b"\x00\xd8a\x00"))
    assert lone["name"] == "\ufffda" and lone["name_raw"] == b"\x00\xd8a\x00"
    assert D.file_name(b"short") is None
