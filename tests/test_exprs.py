import datetime as dt
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from image_builder import encode_runs
from mftlake.functions import exprs as X
from mftlake.sources import decode as D


def test_integers(spark):
    rng = random.Random(1)
    raws = [bytes(rng.randrange(256) for _ in range(16)) for _ in range(50)] + [b"\xff" * 16, b"\0" * 16, b"abc"]
    at = lambda o, w: X.le_uint(F.col("raw"), o, w)
    df = spark.createDataFrame([(r,) for r in raws], "raw binary")
    for r in df.select("raw", at(0, 1).alias("a"), at(1, 2).alias("b"), at(3, 4).alias("c"), at(8, 8).alias("d"), X.sign_extend(at(1, 3), 3).alias("e")).collect():
        raw = bytes(r["raw"])
        if len(raw) < 16:
            assert r["a"] == raw[0] and r["c"] is None and r["d"] is None
            continue
        assert (r["a"], r["b"], r["c"], int(r["d"])) == (raw[0], *struct.unpack_from("<HI", raw, 1), struct.unpack_from("<Q", raw, 8)[0])
        assert r["e"] == int.from_bytes(raw[1:4], "little", signed=True)


def test_bytes_of_integers(spark):
    rows = spark.range(5).select(X.le_bytes(F.col("id") * 70_000 + 3, 4).alias("b")).collect()
    assert [int.from_bytes(r["b"], "little") for r in rows] == [i * 70_000 + 3 for i in range(5)]


def test_times(spark):
    moments = [dt.datetime(1601, 1, 1), dt.datetime(1970, 1, 1), dt.datetime(2020, 2, 29, 23, 59, 59, 999999)]
    ticks = [(m - dt.datetime(1601, 1, 1)) // dt.timedelta(microseconds=1) * 10 for m in moments]
    df = spark.createDataFrame([(t + 7,) for t in ticks], "t long")
    assert [r[0] for r in df.select(X.from_filetime(F.col("t")).cast("timestamp_ntz")).collect()] == moments
    assert [r[0] for r in df.select(X.filetime(X.from_filetime(F.col("t")))).collect()] == ticks
    assert df.select(X.format_time(X.from_filetime(F.col("t")))).collect()[2][0] == "2020-02-29  23:59"


def test_hex_lines(spark):
    sizes = [0, 8, 15, 16, 17, 16_384, 16_385]
    df = spark.createDataFrame([(n, bytes(i % 256 for i in range(n))) for n in sizes], "n int, b binary")
    got = {r["n"]: r["x"] for r in df.select("n", X.hex_lines(F.col("b")).alias("x")).collect()}
    assert {n: len(x) for n, x in got.items()} == {0: 0, 8: 1, 15: 1, 16: 1, 17: 2, 16_384: 1024, 16_385: 1024}
    assert got[8][0]["hex"] == "00 01 02 03 04 05 06 07 - FF FF FF FF FF FF FF FF"
    assert got[17][1]["offset"] == "0010" and got[16_384][4]["ascii"] == "@ABCDEFGHIJKLMNO"


def test_paths_and_names(spark):
    df = spark.createDataFrame([(p,) for p in (r'"C:\a b\\c\"', "  d : ", "X:\\", r"e:one")], "p string")
    got = [(r["v"], r["x"]) for r in df.select(X.path_volume(F.col("p")).alias("v"), X.path_parts(F.col("p")).alias("x")).collect()]
    assert got == [("C", ["a b", "c"]), ("D", []), ("X", []), ("E", [])]
    names = spark.createDataFrame([("a.txt", 1), ("A.TXT", 2), ("", 1), (None, 0), ("xa.txt", 3)], "name string, namespace int")
    assert [r[0] for r in names.select(X.is_win32_name(F.col("name"), F.col("namespace"))).collect()] == [True, False, False, False, True]
    assert [r[0] for r in names.select(X.matches_whole(F.col("name"), r"a\.txt|b")).collect()] == [True, False, False, None, False]
    assert [r[0] for r in names.select(X.same_name(F.col("name"), F.lit("A.txt"))).collect()] == [True, True, False, None, False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1 << 30), st.one_of(st.none(), st.integers(1, 1 << 40))), max_size=12))
def test_runs_round_trip(runs):
    last, kept = 0, []
    for n, lcn in runs:  # an extent at the last one's place has no offset, which means sparse
        if lcn is None or lcn != last:
            kept.append((n, lcn))
            last = last if lcn is None else lcn
    coded, status = D.runs(encode_runs(kept))
    assert status == "ok" and [(n, at) for _, n, at in D.placed(coded)] == kept
