"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, pick, read

#: bytes of context at most
DEPTH = 4
#: of a tree that is held whole on the driver (see :func:`train`): at most NODES times the cube root of all training bytes contexts of one length have a node
#: of their own, those with that share of all bytes or more
NODES = 5.0
#: bytes with their context whose chances are shipped to where texts are read, the most frequent ones; all others meet theirs in a join
SHIPPED = 1 << 21
#: bytes with their context that one task weighs at a time
WEIGHED = 50_000
#: share of all training tokens from which a word's count is shipped to where texts are read: at most 1 / SHARE words have it
SHARE = 1 / 4096
#: bytes of text handled at a time, and counts that a worker gathers before it hands them on
SLICE_BYTES, GATHERED = 4 << 20, 1_500_000
GRAM, WORD = 0, 1
#: the token after the last word; no word has this hash, as it is that of the empty string
END = int(np.uint64(xxhash.xxh64_intdigest(b"")).view(np.int64))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the identifier as text leaves 2 modulo 7; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def _laid_out(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each after ``depth`` zeros and before one, and where each begins (with its zeros)."""
    laid = pc.binary_join_element_wise(b"\0" * depth, pc.fill_null(texts, "").cast(pa.binary()), b"\0", b"")
    _, offsets, data = laid.buffers()
    ends = np.frombuffer(offsets, np.int32)[laid.offset : laid.offset + len(laid) + 1]
    return _lower(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]), ends - ends[0]


def _coded(data: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Places of the bytes that are coded: all but the zeros that stand before a text."""
    coded = np.ones(len(data), bool)
    for i in range(depth):
        coded[begins[:-1] + i] = False
    return np.flatnonzero(coded)


def _grams(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The bytes at ``at`` in the lowest eight bits, each with its context above, the newest byte lowest."""
    gram = np.zeros(len(at), np.int64)
    for i in range(depth, -1, -1):
        gram = (gram << 8) | data[at - i]
    return gram


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64).view(np.int64)


def _bytes_lower(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode().lower()


def counts(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind``, ``key``, ``n``: occurrences of every byte with its context (GRAM) and of every word's hash (WORD, END included) in ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, words = np.empty(0, np.uint64), np.empty(0, np.int64), Counter()

        def out(kind: int, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        def tokens() -> pa.RecordBatch:
            return out(WORD, _hashes(words), np.fromiter(words.values(), np.int64, len(words)))

        for whole in batches:
            for batch in _slices(whole, 0):
                data, begins = _laid_out(batch.column(0), depth)
                at = _coded(data, begins, depth)
                k, n = np.unique(_grams(data, at, depth).view(np.uint64), return_counts=True)
                both = np.concatenate([keys, k])
                order = np.argsort(both, kind="stable")
                both, each = both[order], np.concatenate([times, n])[order]
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
                keys, times = both[first], np.add.reduceat(each, first)
                if len(keys) > GATHERED:
                    yield out(GRAM, keys, times)
                    keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
                for text in batch.column(0):
                    words.update(_bytes_lower(text).split())
                words[b""] += len(batch)
                if len(words) > GATHERED:
                    yield tokens()
                    words = Counter()
        if len(keys):
            yield out(GRAM, keys, times)
        if words:
            yield tokens()

    made = df.select("_text").mapInArrow(run, "kind byte, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers: Stirling's series from 8 on, the recursion below."""
    small = x < 8
    y = np.where(small, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    product = np.ones_like(x)
    for i in range(8):
        product = product * np.where(small, x + i, 1.0)
    return series - np.log(product)


def _nodes(counts_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 binary decisions that code a byte, by level and then by the bits before, from counts of bytes."""
    zeros, ones, level = [], [], counts_
    while level.shape[1] > 1:
        zeros.append(level[:, 0::2])
        ones.append(level[:, 1::2])
        level = level[:, 0::2] + level[:, 1::2]
    return np.concatenate(zeros[::-1], axis=1), np.concatenate(ones[::-1], axis=1)


def _kt(counts_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every decision: log probability of what was seen, and the chance of a one next, by Krichevsky and Trofimov."""
    a, b = _nodes(counts_)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1), (b + 0.5) / (a + b + 1)


@dataclass(frozen=True)
class ContextTree:
    """``child[256 * state + byte]``: the state of the context one byte longer, or 0. ``row[state]``: its line of ``table``, log10 chances of bytes.

    State 1 has no context. A state's line is what predicts where the next older byte leads no further.
    """

    depth: int
    child: np.ndarray
    row: np.ndarray
    table: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text and its end."""
        data, begins = _laid_out(texts, self.depth)
        at = _coded(data, begins, self.depth)
        state = np.ones(len(at), np.int32)
        row = np.full(len(at), self.row[1], np.int32)
        for d in range(1, self.depth + 1):
            state = self.child[(state << 8) | data[at - d]]
            row = np.where(state > 0, self.row[state], row)
        logs = self.table[(row << 8) | data[at]].astype(np.float64)
        return np.add.reduceat(logs, begins[:-1] - self.depth * np.arange(len(texts))) if len(texts) else np.empty(0)


def weigh(levels: list[dict[int, np.ndarray]]) -> ContextTree:
    """The mixture over all depths from byte counts by context: ``levels[d][context]`` has 256 counts; its suffixes are in the levels before.

    Contexts that are not split out of their parent share one leaf beside those that are. Every decision's weighted
    probability is half its own estimate and half the product of its children's, from the deepest level up; what predicts
    is each context's estimate and what lies below, by their weights after the training data.
    """
    depth = len(levels) - 1
    order = [sorted(level) for level in levels]
    place = [{c: i for i, c in enumerate(o)} for o in order]
    seen = [np.array([levels[d][c] for c in order[d]], np.float64).reshape(-1, 256) for d in range(depth + 1)]
    parent = [None] + [np.array([place[d - 1][c & ((1 << 8 * (d - 1)) - 1)] for c in order[d]], np.int64) for d in range(1, depth + 1)]
    rest, rest_chance, own_chance, weight = [None] * depth, [None] * depth, [None] * depth, [None] * depth
    below_log, below_chance = _kt(seen[depth])
    deepest = below_chance
    for d in range(depth - 1, -1, -1):
        left = seen[d].copy()
        np.subtract.at(left, parent[d + 1], seen[d + 1])
        rest_log, rest_chance[d] = _kt(left)
        split = rest_log
        np.add.at(split, parent[d + 1], below_log)
        own, own_chance[d] = _kt(seen[d])
        total = np.logaddexp(own, split) + np.log(0.5)
        weight[d] = np.exp(own + np.log(0.5) - total)
        below_log = total
    lines = []
    for d in range(depth + 1):
        chance, at = (deepest, parent[depth]) if d == depth else (rest_chance[d], np.arange(len(order[d])))
        for up in range(min(d, depth - 1), -1, -1):
            chance = weight[up][at] * own_chance[up][at] + (1 - weight[up][at]) * chance
            at = parent[up][at] if up else at
        log = np.zeros((len(chance), 1))
        for level in range(8):
            one = chance[:, (1 << level) - 1 : (2 << level) - 1]
            log = np.stack([log + np.log10(1 - one), log + np.log10(one)], axis=2).reshape(len(chance), 2 << level)
        lines.append(log)
    table = np.concatenate(lines).astype(np.float32).ravel()
    first = np.cumsum([1, *map(len, order)])
    child = np.zeros(256 * int(first[-1]), np.int32)
    for d in range(1, depth + 1):
        for i, c in enumerate(order[d]):
            child[256 * int(first[d - 1] + parent[d][i]) + (c >> 8 * (d - 1))] = first[d] + i
    return ContextTree(depth, child, np.arange(int(first[-1]), dtype=np.int32) - 1, table)


def train(table: DataFrame, depth: int = DEPTH, nodes: float = NODES) -> ContextTree:
    """The tree of the GRAM rows of :func:`counts`.

    Contexts are summed over the whole corpus at every length; those with at least 1 / (``nodes`` times the cube root of all bytes) of them reach the
    driver, with 256 counts each. No bytes: every byte has the same chance.
    """
    grams = table.filter(F.col("kind") == GRAM)
    every = grams.agg(F.sum("n")).first()[0] or 0
    levels: list[dict[int, np.ndarray]] = [{} for _ in range(depth + 1)]
    levels[0][0] = np.zeros(256, np.int64)
    if every:
        by_depth = grams.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "key", "n").select(
            "d", F.expr("shiftright(key, 8) & (shiftleft(1L, 8 * d) - 1)").alias("context"), F.expr("cast(key & 255 as int)").alias("byte"), "n"
        )
        summed = by_depth.groupBy("d", "context", "byte").agg(F.sum("n").alias("n"))
        large = summed.groupBy("d", "context").agg(F.sum("n").alias("m")).filter((F.col("m") * nodes >= every ** (2 / 3)) | (F.col("d") == 0)).select("d", "context")
        got = summed.join(F.broadcast(large), ["d", "context"]).toArrow()
        for d, c, b, n in zip(*(got[x].to_pylist() for x in ("d", "context", "byte", "n"))):
            levels[d].setdefault(c, np.zeros(256, np.int64))[b] = n
    return weigh(levels)


@dataclass(frozen=True)
class Chances:
    """log10 chances of bytes with their contexts, by sorted key (see :func:`counts`)."""

    depth: int
    keys: np.ndarray
    logs: np.ndarray

    def _found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key of every byte, the place that it has or would have among ``keys``, whether it is there, and where each text begins."""
        data, begins = _laid_out(texts, self.depth)
        gram = _grams(data, _coded(data, begins, self.depth), self.depth)
        # looked up in their order, which stays within the caches
        order = np.argsort(gram)
        place = np.empty(len(gram), np.int64)
        place[order] = np.searchsorted(self.keys, gram[order])
        place = np.minimum(place, max(len(self.keys) - 1, 0))
        there = self.keys[place] == gram if len(self.keys) else np.zeros(len(gram), bool)
        return gram, place, there, begins[:-1] - self.depth * np.arange(len(texts))

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of what is known of each text and its end."""
        if not len(texts):
            return np.empty(0)
        _, place, there, begins = self._found(texts)
        return np.add.reduceat(np.where(there, self.logs[place], 0.0) if len(self.keys) else np.zeros(len(place)), begins)

    def missing(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, key and times of every byte with its context that is not known, each once a text."""
        gram, _, there, begins = self._found(texts)
        owner = np.searchsorted(begins, np.flatnonzero(~there), "right") - 1
        key = gram[~there]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        return owner[first], key[first], np.diff(np.append(first, len(key)))


def _kt_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - np.log(np.pi) - _lgamma(a + b + 1), (b + 0.5) / (a + b + 1)


def _mixed(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a decision, and the weight of its own estimate after the training data."""
    total = np.logaddexp(own, split) + np.log(0.5)
    return total, np.exp(own + np.log(0.5) - total)


def _weighed(key: np.ndarray, n: np.ndarray, depth: int, top: int):
    """The tree's part from depth ``top`` down, of whole contexts of that length.

    Of every decision of a byte that occurs (bytes by 8): the chance of a one by what lies from ``top`` on, its place among the decisions at ``top``, whether it was a one; of
    the decisions at ``top``: context and decision, zeros, ones, log weighted probability. A context without counts gives even chances.
    """
    byte = (key & 255)[:, None]
    level = np.arange(8)
    node, bit = (1 << level) - 1 + (byte >> (8 - level)), ((byte >> (7 - level)) & 1).astype(bool)
    at = (((key >> 8)[:, None] << 8) | node).ravel()
    times, one = np.repeat(n, 8).astype(np.float64), bit.ravel()
    context, place = np.unique(at, return_inverse=True)
    a = np.bincount(place, np.where(one, 0, times), len(context))
    b = np.bincount(place, np.where(one, times, 0), len(context))
    below, chance = _kt_of(a, b)
    up = np.arange(len(context))
    for d in range(depth - 1, top - 1, -1):
        shorter, parent = np.unique((((context >> 8) & ((1 << 8 * d) - 1)) << 8) | (context & 255), return_inverse=True)
        a, b = np.bincount(parent, a, len(shorter)), np.bincount(parent, b, len(shorter))
        own, own_chance = _kt_of(a, b)
        below, weight = _mixed(own, np.bincount(parent, below, len(shorter)))
        up = parent[up]
        chance = weight[up] * own_chance[up] + (1 - weight[up]) * chance
        context = shorter
    return chance[place], up[place], one, context, a, b, below


def chances(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key``, ``log`` (log10 chance of the byte after its context) of every row of ``grams`` (``key``, ``n``: training occurrences, which may be none).

    The mixture over all contexts of up to ``depth`` bytes that the training data has, none left out. Contexts that end in the same two bytes
    are weighed together, in as many tasks as there are bytes with contexts for; the driver gets what these come to for the contexts of one byte, at most 65,280 rows.
    """
    top = min(2, depth)
    parts = grams.count() // WEIGHED + 1
    parted = grams.select("key", "n", F.expr(f"pmod(xxhash64(shiftright(key, 8) & {(1 << 8 * top) - 1}L), {parts})").alias("part"))
    columns = lambda t: (t.column("key").to_numpy(), t.column("n").to_numpy())

    def summed(t: pa.Table) -> pa.Table:
        _, _, _, at, a, b, below = _weighed(*columns(t), depth, top)
        return pa.table({"at": at, "a": a, "b": b, "below": below})

    alpha, beta, known = np.zeros(1), np.ones(1), np.zeros(1, np.int64)
    if top:
        shorter = (1 << 8 * (top - 1)) - 1
        sums = parted.groupBy("part").applyInArrow(summed, "at long, a double, b double, below double")
        got = sums.groupBy(F.expr(f"shiftleft(shiftright(at, 8) & {shorter}L, 8) | (at & 255)").alias("at")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).orderBy("at").toArrow()
        known, a, b, split = (got.column(x).to_numpy() for x in ("at", "a", "b", "below"))
        context, up = known, np.arange(len(known))
        alpha, beta = np.zeros(len(known)), np.ones(len(known))
        for d in range(top - 1, -1, -1):
            own, own_chance = _kt_of(a, b)
            total, weight = _mixed(own, split)
            alpha, beta = weight[up] * own_chance[up] + (1 - weight[up]) * alpha, (1 - weight[up]) * beta
            if d:
                context, parent = np.unique((((context >> 8) & ((1 << 8 * (d - 1)) - 1)) << 8) | (context & 255), return_inverse=True)
                a, b, split, up = (*(np.bincount(parent, x, len(context)) for x in (a, b, total)), parent[up])
    shipped = grams.sparkSession.sparkContext.broadcast((known, alpha, beta))

    def logs(t: pa.Table) -> pa.Table:
        key, n = columns(t)
        chance, place, one, at, *_ = _weighed(key, n, depth, top)
        if top:
            known, alpha, beta = shipped.value
            i = np.searchsorted(known, (((at >> 8) & ((1 << 8 * (top - 1)) - 1)) << 8) | (at & 255))[place]
            chance = alpha[i] + beta[i] * chance
        return pa.table({"key": key, "log": np.log10(np.where(one, chance, 1 - chance)).reshape(-1, 8).sum(axis=1)})

    return parted.groupBy("part").applyInArrow(logs, "key long, log double")


def _whole(rows: DataFrame, table: DataFrame, depth: int) -> tuple[Chances, DataFrame | None]:
    """Chances of all bytes with their contexts in ``rows``, by the training counts ``table``: the most frequent SHIPPED, and a table of the rest if there is one."""
    seen = table.filter(F.col("kind") == GRAM).select("key", "n", F.col("n").alias("all"))
    held = counts(rows.filter("_held"), depth).filter(F.col("kind") == GRAM).select("key", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("all"))
    grams = cut(seen.unionByName(held).groupBy("key").agg(F.sum("n").alias("n"), F.sum("all").alias("all")))
    made = cut(chances(grams, depth).join(grams.select("key", F.expr("cast(log2(all) as int)").alias("size")), "key"))
    sizes, least, total = {r["size"]: r["count"] for r in made.groupBy("size").count().collect()}, 64, 0
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > SHIPPED:
            break
        least = size
    top = made.filter(F.col("size") >= least).select("key", "log").toArrow()
    keys, logs = top.column("key").to_numpy(), top.column("log").to_numpy()
    order = np.argsort(keys)
    discard(grams)
    return Chances(depth, keys[order], logs[order]), made.filter(F.col("size") < least) if total > len(keys) else None


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_if: Column | None = None, depth: int = DEPTH, nodes: float | None = None, share: float = SHARE) -> DataFrame:
    """``_id``, ``_held``, ``_n_tokens``, ``_n_known``, ``_train_tokens``, ``_base``, ``_score`` and ``_bits`` (code length per byte, the end being one) of every row of ``df``.

    Learns from the rows for which ``train_if`` (on ``_id``) holds; by default those that :func:`held_out` leaves. ``_base`` is the
    score of add-one word frequencies. ``_score`` is that of the whole tree, all contexts of the training rows (see :func:`chances`); ``nodes`` asks for the smaller one
    of :func:`train` instead. Words with ``share`` of all training tokens are shipped to where texts are
    read; all others meet their counts in a join, each with too few rows to weigh on one task. Null texts count as
    empty. Repeated rows get equal answers, one each. An empty table gives no rows; with nothing to learn from, chances are even.
    """
    rows = pick(df, _id=id_col, _text=text_col).withColumn("_text", F.coalesce(F.col("_text").cast("string"), F.lit("")))
    rows = rows.withColumn("_held", ~F.coalesce(train_if, F.lit(False)) if train_if is not None else held_out("_id"))
    table = cut(counts(rows.filter(~F.col("_held")), depth))
    tree, deep = _whole(rows, table, depth) if nodes is None else (train(table, depth, nodes), None)
    words = table.filter(F.col("kind") == WORD)
    total, distinct, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("key") == END, F.col("n"))), F.lit(0))).first()
    frequent = {r["key"]: r["n"] for r in words.filter((F.col("n") >= F.lit(total * share)) & (F.col("key") != END)).collect()}  # at most 1 / share
    context = df.sparkSession.sparkContext
    shipped = context.broadcast((tree, {k: float(np.log10(n + 1)) for k, n in frequent.items()}))
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    head_type = T.StructType([rows.schema["_id"], *longs("_x", "_n", "_m", "_bytes"), T.StructField("_sum", T.DoubleType()), T.StructField("_score", T.DoubleType())])
    word_type = T.StructType([rows.schema["_id"], *longs("_x", "_key", "_times")])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text: its tokens, what frequent words give, the tree's score."""
        tree, known = shipped.value
        for whole in batches:
            for batch in _slices(whole, 2):
                n, m, sums = [], [], []
                for text in batch.column(2):
                    tf = Counter(_bytes_lower(text).split())
                    logs = [(c, known[k]) for k, c in zip(_hashes(tf).tolist(), tf.values()) if k in known]
                    n.append(sum(tf.values()) + 1)
                    m.append(sum(c for c, _ in logs))
                    sums.append(sum(c * log for c, log in logs))
                made = (pa.array(n, pa.int64()), pa.array(m, pa.int64()), pc.binary_length(batch.column(2)).cast(pa.int64()), pa.array(sums, pa.float64()), pa.array(tree.score(batch.column(2)), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=head_type.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every other word of a text."""
        known = shipped.value[1]
        for whole in batches:
            for batch in _slices(whole, 2):
                owner, keys, times = [], [], []
                for i, text in enumerate(batch.column(2)):
                    tf = Counter(_bytes_lower(text).split())
                    here = [(k, c) for k, c in zip(_hashes(tf).tolist(), tf.values()) if k not in known]
                    owner += [i] * len(here)
                    keys += [k for k, _ in here]
                    times += [c for _, c in here]
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys, pa.int64()), pa.array(times, pa.int64())], names=word_type.names)

    def unshipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every byte with its context of a text whose chance was not shipped."""
        known = shipped.value[0]
        for whole in batches:
            for batch in _slices(whole, 2):
                owner, keys, times = known.missing(batch.column(2))
                take = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(keys, pa.int64()), pa.array(times, pa.int64())], names=word_type.names)

    keyed = rows.select("_id", F.xxhash64("_text").alias("_x"), "_text")
    rare = keyed.mapInArrow(others, word_type).join(words.select("key", F.col("n").alias("_c")), F.col("_key") == F.col("key"))
    rare = rare.select("_id", "_x", F.col("_times").alias("_m"), (F.col("_times") * F.log10(F.col("_c") + 1)).alias("_sum"))
    rare = rare.withColumn("_deep", F.lit(0.0))
    if deep is not None:
        # bytes with rare contexts: their logs are summed as the words' are
        gone = keyed.mapInArrow(unshipped, word_type).join(deep.select("key", "log"), F.col("_key") == F.col("key"))
        rare = rare.unionByName(gone.select("_id", "_x", F.lit(0).cast("bigint").alias("_m"), F.lit(0.0).alias("_sum"), (F.col("_times") * F.col("log")).alias("_deep")))
    # a row of equal id and text stands for each of them: its words are counted once for each, so they are shared among them
    both = keyed.mapInArrow(heads, head_type).withColumn("_head", F.lit(1)).unionByName(rare.withColumn("_head", F.lit(0)), allowMissingColumns=True)
    summed = both.groupBy("_id", "_x").agg(
        F.max("_n").alias("_n"), F.max("_bytes").alias("_bytes"), F.max("_score").alias("_shipped"), F.sum("_m").alias("_m"), F.sum("_sum").alias("_sum"), F.sum("_deep").alias("_deep"), F.sum("_head").cast("int").alias("_copies")
    )
    single = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    single = single.withColumn("_score", F.col("_shipped") + F.coalesce(F.col("_deep"), F.lit(0.0)) / F.col("_copies"))
    divisor = float(total + distinct + 1)
    end_known = 1 if ends else 0
    return single.select(
        "_id",
        (~F.coalesce(train_if, F.lit(False)) if train_if is not None else held_out("_id")).alias("_held"),
        F.col("_n").alias("_n_tokens"),
        (F.expr("_m div _copies") + end_known).alias("_n_known"),
        F.lit(total).cast("bigint").alias("_train_tokens"),
        (F.col("_sum") / F.col("_copies") + F.lit(float(np.log10(ends + 1))) - F.col("_n") * F.lit(float(np.log10(divisor)))).alias("_base"),
        "_score",
        (-F.col("_score") * F.lit(float(np.log2(10))) / (F.col("_bytes") + 1)).alias("_bits"),
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_held").alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_known").alias("n_known"),
        F.col("_train_tokens").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
        F.col("_bits").alias("bits_per_byte"),
    )
