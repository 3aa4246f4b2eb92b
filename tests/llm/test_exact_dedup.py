import hashlib
from collections import Counter

import pytest

from mftlake.llm import exact_dedup as E


def docs():
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 40}") for i in range(200)] + [(300, None), (301, ""), (5, "t5"), (5, "t5"), (None, "t7"), (None, "only null id"), (302, "x" * 300_000)]
    return rows


@pytest.mark.parametrize("fanout,rounds", [(16, 2), (2, 3), (4, 0)])
def test_equals_brute_force(spark, fanout, rounds):
    rows = docs()
    got = E.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), fanout=fanout, rounds=rounds).collect()
    assert len(got) == len(rows)
    size, top = Counter(t or "" for _, t in rows), {}
    for i, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    by_sha = {hashlib.sha256(t.encode()).digest(): t for t in size}
    kept = Counter()
    for r in got:
        t = by_sha[bytes(r["_sha"])]
        assert r["_size"] == size[t] and (-1 if r["_keep"] is None else r["_keep"]) == top[t]
        kept[t] += r["_kept"]
        assert not r["_kept"] or r["_id"] == r["_keep"]
    assert set(kept.values()) == {1} and kept.keys() == size.keys()


def test_smallest_can_stay_and_columns_do(spark):
    df = spark.createDataFrame([(1, "a", "p", 7), (2, "a", "q", 8), (3, "b", "r", 9)], "doc_id long, text string, _sha string, _at int")
    out = E.exact_dedup(df, keep="min")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a", "p", 7), (3, "b", "r", 9)]
    assert E.exact_dedup(df.limit(0)).count() == 0
