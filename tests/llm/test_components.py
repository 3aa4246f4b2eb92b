import random

from mftlake.llm import common
from mftlake.llm import components as C


def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_plans_stay_small_and_broadcast_hot_nodes_only(spark, monkeypatch):
    """The driver keeps every plan and broadcast of a round: neither may grow with the rounds, nor be there for nothing."""
    rng = random.Random(3)
    chain = list(range(60))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, i) for i in range(1001, 1100)] + [(1099, 1200)]
    plans, spread, cut, join = [], [], C.cut, C.spread_join

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    def joined(*args):
        spread.append(args)
        return join(*args)

    monkeypatch.setattr(C, "cut", seen)
    monkeypatch.setattr(C, "spread_join", joined)
    for hot_rows, hot in ((1 << 20, False), (16, True)):
        monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
        got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == roots(edges) and bool(spread) == hot
        if not hot:
            assert len(plans) > 8 and max(p.count("Exchange") for p in plans) <= 8, max(plans, key=len)
