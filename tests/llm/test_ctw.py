import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mftlake.llm import ctw as W


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


class Plain:
    """Context-tree weighting, one binary decision at a time: contexts that are large enough are split, the rest of each shares a leaf."""

    def __init__(self, texts, depth, nodes):
        self.depth, grams = depth, Counter()
        for t in texts:
            data = bytes(depth) + t.encode().lower() + b"\0"
            for i in range(depth, len(data)):
                grams[data[i - depth : i][::-1], data[i]] += 1  # newest byte first
        total = sum(grams.values())
        size = Counter()
        for (c, _), n in grams.items():
            for d in range(depth + 1):
                size[c[:d]] += n
        self.large = {c for c, n in size.items() if n * nodes >= total ** (2 / 3)} | {b""}
        self.grams = grams
        self.memo = {}

    def counts(self, member, path):
        a = b = 0
        for (c, s), n in self.grams.items():
            bits = f"{s:08b}"
            if bits.startswith(path) and member(c):
                a, b = (a + n, b) if bits[len(path)] == "0" else (a, b + n)
        return a, b

    def node(self, c, path):
        """(own counts, log weighted, weight of own, children) for a split context."""
        key = (c, path)
        if key not in self.memo:
            a, b = self.counts(lambda x: x[: len(c)] == c, path)
            if len(c) == self.depth:
                self.memo[key] = (a, b, kt(a, b), 1.0, (0, 0))
            else:
                kids = [k for k in self.large if len(k) == len(c) + 1 and k[: len(c)] == c]
                ra, rb = self.counts(lambda x: x[: len(c)] == c and x[: len(c) + 1] not in kids, path)
                below = kt(ra, rb) + sum(self.node(k, path)[2] for k in kids)
                own = kt(a, b)
                top = max(own, below)
                log = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
                self.memo[key] = (a, b, log, math.exp(own + math.log(0.5) - log), (ra, rb))
        return self.memo[key]

    def chance(self, context, path, d=0):
        a, b, _, w, (ra, rb) = self.node(context[:d], path)
        here = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return here
        below = self.chance(context, path, d + 1) if context[: d + 1] in self.large else (rb + 0.5) / (ra + rb + 1)
        return w * here + (1 - w) * below

    def score(self, text):
        data, total = bytes(self.depth) + text.encode().lower() + b"\0", 0.0
        for i in range(self.depth, len(data)):
            bits, context = f"{data[i]:08b}", data[i - self.depth : i][::-1]
            for k in range(8):
                p = self.chance(context, bits[:k])
                total += math.log10(p if bits[k] == "1" else 1 - p)
        return total


TEXTS = ["abab abba Abab", "the cat sat on the mat", "", "é é", "the bat", "aaaa"]


def test_log_gamma():
    x = np.concatenate([np.arange(1, 60) / 2, [1e3, 1e6, 1e12]])
    assert np.allclose(W._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_tree_equals_plain_weighting(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "_text string")
    tree = W.train(W.counts(df, 2), depth=2, nodes=6.0)
    plain = Plain(TEXTS, 2, 6.0)
    for t in ["abab", "the cat", "zq\x00!", "", "É"]:
        assert math.isclose(tree.score(pa.array([t]))[0], plain.score(t), rel_tol=1e-4, abs_tol=1e-4), t


def test_the_tree_grows_with_the_corpus(spark):
    sizes = []
    for n in (40, 4000):
        df = spark.range(n).selectExpr("concat_ws(' ', transform(sequence(0, 20), i -> hex(xxhash64(id, i)))) as _text")
        sizes.append(len(W.train(W.counts(df, 2), depth=2).row))
    assert sizes[1] > 2 * sizes[0]


def test_chances_add_up(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "_text string")
    tree = W.train(W.counts(df), nodes=20.0)
    assert np.allclose((10.0 ** tree.table.reshape(-1, 256).astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def brute(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter()
    for i, t in rows:
        if not held(i):
            train.update((t or "").encode().lower().split())
            train[b""] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        out.append((i, held(i), len(tokens), sum(train[w] > 0 for w in tokens), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)))
    return out


def test_base_scores_equal_brute_force(spark):
    rows = [(i, " ".join(f"W{(i * k) % 23}" for k in range(i % 19)) + (" x" if i % 5 == 0 else "")) for i in range(120)]
    rows += [(200, None), (201, ""), (7, rows[7][1]), (7, rows[7][1]), (7, "other"), (None, "null id W1"), (202, "rare " * 20_000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, _score double")
    got = W.score(df).collect()
    key = lambda r: (str(r[0]), *r[1:])
    a = sorted(((r["_id"], r["_held"], r["_n_tokens"], r["_n_known"], r["_train_tokens"], r["_base"]) for r in got), key=key)
    b = sorted(brute(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b))
    assert all(r["_score"] < 0 and r["_bits"] > 0 for r in got)


def test_held_out_text_like_the_training_text_is_likelier(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the log") for i in range(60)] + [(1000, "xqz jvk wpf qqz"), (1001, "the dog sat on the mat")]
    got = {r["_id"]: r["_bits"] for r in W.score(spark.createDataFrame(rows, "doc_id long, text string"), train_if=__import__("pyspark.sql.functions", fromlist=["col"]).col("_id") < 1000).collect()}
    assert got[1001] < 2 < got[1000]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert W.score(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = W.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert only["_train_tokens"] == 0 and only["_n_known"] == 0 and math.isclose(only["_score"], 3 * math.log10(1 / 256), rel_tol=1e-6)


def test_scores_are_of_the_whole_tree(spark, monkeypatch):
    """All contexts count, however rare, and whether their chances are shipped or joined."""
    learned = {i: TEXTS[i % len(TEXTS)] + (f" w{i}" if i % 7 == 0 else "") for i in range(40)}
    asked = {1000: "abab w7", 1001: "zq\x00! the cat", 1002: "", 1003: "É the mat", 1004: "abba " * 30}
    df = spark.createDataFrame([*learned.items(), *asked.items(), (1000, "abab w7"), (1005, None)], "doc_id long, text string")
    small = [t for i, t in learned.items()]
    for depth, shipped in ((4, 1 << 21), (4, 12), (1, 12), (0, 1 << 21)):
        monkeypatch.setattr(W, "SHIPPED", shipped)
        monkeypatch.setattr(W, "WEIGHED", 30)
        plain = Plain(small, depth, float("inf"))
        got = [(r["_id"], r["_score"]) for r in W.score(df, train_if=F.col("_id") < 1000, depth=depth).collect() if r["_id"] >= 1000]
        assert sorted(i for i, _ in got) == [1000, 1000, 1001, 1002, 1003, 1004, 1005]
        for i, x in got:
            assert math.isclose(x, plain.score(asked.get(i, "")), rel_tol=1e-6, abs_tol=1e-6), (depth, shipped, i)
