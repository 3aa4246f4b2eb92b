"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, pick, read, unpacked

#: labelled rows that a fit uses at most: those whose hash is smallest, the same number of each label
SAMPLE_ROWS = 4_000
#: a word is known by itself (in lower case) and by its beginnings of these lengths
PREFIXES = (3, 4, 5, 6)
#: grade of a toxic document by its number of words that only toxic documents use: up to the first, the second, above
GRADE_HITS = (2, 5)
#: a document is taken as toxic from this P(grade > 0): clean documents lie near 0.05, a single mild word lifts one to about 0.35
TOXIC_FROM = 0.3
#: chi-squared of a feature and the label, below which it is left out
SCREEN = 35.0
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def features(counts: Counter) -> Counter:
    """Sparse features of a text: words, and word beginnings marked with a circumflex."""
    out: Counter = Counter()
    for w, n in counts.items():
        out[w] += n
        for k in PREFIXES:
            if len(w) >= k:
                out["^" + w[:k]] += n
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(thresholds[k] - weights . x): one weight vector for all ordered thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def __post_init__(self):
        # every feature starts with one of these, which passes over most words at once
        object.__setattr__(self, "heads", frozenset(f.removeprefix("^")[: PREFIXES[0]] for f in self.weights))

    def score(self, text: str | None) -> float:
        """weights . x, where x counts a feature as log(1 + occurrences)."""
        heads, first = self.heads, PREFIXES[0]
        near = Counter({w: n for w, n in words(text).items() if w[:first] in heads})
        return sum(self.weights[f] * math.log1p(n) for f, n in features(near).items() if f in self.weights) if near else 0.0

    @property
    def toxic_from(self) -> float:
        """P(grade > 0) from which a text counts as toxic: TOXIC_FROM, and well above that of a text without any feature."""
        plain = 1 - float(self.at_most(0.0)[0])
        return max(TOXIC_FROM, plain + (1 - plain) / 10) if self.weights else 0.5

    def at_most(self, score: float) -> np.ndarray:
        """P(grade <= k) for every k below the highest grade."""
        return 1 / (1 + np.exp(np.clip(score - np.array(self.thresholds), -60, 60)))

    def severity(self, score: float) -> float:
        """The expected grade: the sum of P(grade > k)."""
        return float((1 - self.at_most(score)).sum())


def _likeness(text: str | None) -> tuple:
    """Equal for most near copies: the three distinct words whose checksums are smallest."""
    return tuple(sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in words(text))[:3])


def _screened(texts: list[str | None], toxic: np.ndarray) -> tuple[list[str], set[str]]:
    """Features that toxic texts have far oftener than clean ones (chi-squared over SCREEN), and those of them that no clean text has."""
    bad, n = Counter(), len(texts)
    for t in (t for t, y in zip(texts, toxic) if y):
        bad.update(features(words(t)).keys())
    bad = {f: k for f, k in bad.items() if k >= 3}
    good = Counter()
    for t in (t for t, y in zip(texts, toxic) if not y):
        good.update(bad.keys() & features(words(t)).keys())
    n1 = int(toxic.sum())
    n0 = n - n1
    chi = {f: n * (k * (n0 - good[f]) - (n1 - k) * good[f]) ** 2 / max(1, (k + good[f]) * (n - k - good[f]) * n1 * n0) for f, k in bad.items() if k * n0 > good[f] * n1}
    return sorted(f for f, x in chi.items() if x >= SCREEN), {f for f, k in bad.items() if not good[f]}


def _grade_of(counts: Counter, telling: set[str]) -> int:
    """Grade of a text labelled toxic: by its number of words that tell (no clean text has them or their beginning)."""
    hit = sum(n for w, n in counts.items() if w in telling or any(len(w) >= k and "^" + w[:k] in telling for k in PREFIXES))
    return 1 + int(np.searchsorted(GRADE_HITS, hit, side="left"))


def train(texts: list[str | None], toxic: list[int], l1: float = 0.0001, rounds: int = 400) -> OrdinalModel:
    """The model by accelerated proximal gradient steps: likelihood of the ordered grades, weights of at least zero and an L1 penalty.

    Near copies of a text count once, lest what happens to stand in a copied text seems to tell.
    Screening and L1 leave weights to few features, so that the many indifferent words of a long text add nothing. The
    labels only say whether a text is toxic; how severe it is, its number of telling words says. Thresholds stay
    ordered as they are kept as a first one and positive differences. Texts of one label only: weights are empty and
    nothing is graded above zero (or everything is, if all are toxic).
    """
    firsts = {}
    for t, y in zip(texts, toxic):
        firsts.setdefault((_likeness(t), bool(y)), t)
    texts, toxic_ = list(firsts.values()), np.array([y for _, y in firsts], bool)
    top = len(GRADE_HITS) + 1
    if not toxic_.any() or toxic_.all():
        return OrdinalModel({}, tuple((-40.0 if len(toxic_) and toxic_.all() else 40.0) + k for k in range(top)))
    names, telling = _screened(texts, toxic_)
    place = {f: i for i, f in enumerate(names)}
    grades = np.zeros(len(texts), np.int64)
    row, col, val = array("i"), array("i"), array("d")
    for i, t in enumerate(texts):
        counts = words(t)
        if toxic_[i]:
            grades[i] = _grade_of(counts, telling)
        for f, k in features(counts).items():
            j = place.get(f)
            if j is not None:
                row.append(i), col.append(j), val.append(math.log1p(k))
    row_, col_, val_ = np.array(row, np.int64), np.array(col, np.int64), np.array(val)
    n, d = len(texts), len(names)
    # both labels weigh the same
    weight = np.where(toxic_, 0.5 / toxic_.sum(), 0.5 / (~toxic_).sum())
    scale = np.minimum(np.maximum(np.bincount(col_, val_**2 * weight[row_], d), 1e-9) ** -0.5, 30.0)  # features enter with unit second moment
    val_ = val_ * scale[col_]

    def loss_grad(w: np.ndarray, cuts: np.ndarray):
        z = np.bincount(row_, val_ * w[col_], n)
        bound = np.concatenate([[-50.0], np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])), [50.0]])
        s = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
        hi, lo = s(bound[grades + 1] - z), s(bound[grades] - z)
        p = np.maximum(hi - lo, 1e-12)
        dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
        gz = weight * (dh - dl)
        gb = np.bincount(grades + 1, -weight * dh, top + 2) + np.bincount(grades, weight * dl, top + 2)
        gb = gb[1 : top + 1]
        tail = np.cumsum(gb[::-1])[::-1]
        return -(weight * np.log(p)).sum(), np.bincount(col_, val_ * gz[row_], d), np.concatenate([tail[:1], tail[1:] * np.exp(cuts[1:])])

    w, cuts = np.zeros(d), np.concatenate([[1.0], np.zeros(top - 1)])
    yw, yc, t, step = w.copy(), cuts.copy(), 1.0, 1.0
    for _ in range(rounds):
        f, gw, gc = loss_grad(yw, yc)
        while True:
            nw = yw - step * gw
            nw = np.maximum(nw - step * l1, 0)
            nc = yc - step * gc
            dw, dc = nw - yw, nc - yc
            if step < 1e-6 or loss_grad(nw, nc)[0] <= f + gw @ dw + gc @ dc + (dw @ dw + dc @ dc) / (2 * step) + 1e-12:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yc = nw + (t - 1) / t2 * (nw - w), nc + (t - 1) / t2 * (nc - cuts)
        w, cuts, t = nw, nc, t2
        step *= 1.1
    w = w * scale
    keep = np.flatnonzero(w)
    return OrdinalModel({names[i]: float(w[i]) for i in keep}, tuple(np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])).tolist()))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Trains on at most ``sample_rows`` labelled rows, half of them toxic as far as there are so many, taken by the hash of their identifiers.

    The bound holds for what reaches the driver at any size of the tables. Labels that are null, and labels without a text, count for nothing.
    """
    given = pick(labels, _lid=id_col, _y=label_col).filter("_y is not null").select("_lid", (F.col("_y") > 0).cast("int").alias("_y"))
    chosen = None
    for y in (0, 1):
        part = given.filter(F.col("_y") == y).orderBy(F.xxhash64("_lid"), "_lid").limit(sample_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = pick(df, _id=id_col, _text=text_col)
    joined = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_id", F.col("_text").cast("string").alias("_text"), "_y")
    table = joined.orderBy(F.xxhash64("_id"), "_id", "_text").limit(sample_rows).toArrow()
    return train(table["_text"].to_pylist(), table["_y"].to_pylist())


def grade(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row``, ``_id``, ``_severity`` (expected grade), ``_p_toxic`` (P(grade > 0)), ``_grade`` (the likeliest) of every row.

    Null and empty texts have no features and score zero. Other columns travel in ``_row``. An empty table gives no rows.
    """
    rows = packed(df, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    scored = rows.select("_row", "_id", score("_text").alias("_z"))
    over = [1 / (1 + F.exp(F.lit(float(c)) - F.col("_z"))) for c in model.thresholds]
    share = [1 - over[0], *(a - b for a, b in zip(over, over[1:])), over[-1]]
    likeliest = F.array_position(F.array(*share), F.array_max(F.array(*share))).cast("int") - 1
    return scored.select("_row", "_id", sum(over[1:], over[0]).alias("_severity"), over[0].alias("_p_toxic"), likeliest.alias("_grade"))


def drop_toxic(df: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``df`` taken as clean: P(grade > 0) below ``threshold``, by default the model's own."""
    limit = model.toxic_from if threshold is None else threshold
    return unpacked(grade(df, model, id_col, text_col).filter(F.col("_p_toxic") < limit), df.columns)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fit(documents, read(spark, sf_dir, "labels"))
    return grade(documents, model).select(
        F.col("_id").alias("doc_id"),
        F.round("_severity", 6).alias("severity"),
        F.col("_grade").alias("grade"),
        F.round("_p_toxic", 6).alias("p_toxic"),
        (F.col("_p_toxic") >= model.toxic_from).alias("toxic"),
    )
