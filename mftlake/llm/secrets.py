"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pick, read

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

#: strings that are tested, and the shortest one; a digit must be in them
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: alphabets by inferred encoding, the narrowest that holds a candidate first (fixed values)
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
RANK = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: length bands of the false-discovery control: from 16, 24, 32, 48, 64, 128 characters on
BANDS = (16, 24, 32, 48, 64, 128)
#: bins of -log10 p that the control counts
BINS = 400
RATE = 0.01


def encoding(text: str) -> str | None:
    """The narrowest alphabet that holds the text (padding aside); None: no one does."""
    chars = set(text.rstrip("="))
    return next((name for name, rank in RANK.items() if chars <= rank.keys()), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(text: str, name: str) -> tuple[float, float, float]:
    """Two-sided or upper p-values of a text's randomness over its alphabet: uniformity, runs, serial correlation.

    Uniformity: chi-squared of the character counts (Wilson and Hilferty's normal form, as texts are short). Runs: Wald
    and Wolfowitz's count of runs above and below the alphabet's middle. Serial correlation: of each rank with the next.
    """
    rank = RANK[name]
    x = [rank[c] for c in text.rstrip("=")]
    n, k = len(x), len(rank)
    counts: dict[int, int] = {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    chi = sum(v * v for v in counts.values()) * k / n - n
    # the exact mean and variance of the statistic for n draws
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    uniform = _normal_tail((chi - mean) / math.sqrt(max(var, 1e-9)))
    above = sum(2 * v >= k for v in x)
    below = n - above
    runs = 1.0
    if n > 2:
        if above and below:
            count = 1 + sum((2 * a >= k) != (2 * b >= k) for a, b in zip(x, x[1:]))
            m = 2 * above * below / n + 1
            s = math.sqrt(max((m - 1) * (m - 2) / (n - 1), 1e-9))
            runs = 2 * _normal_tail(abs(count - m) / s)
        else:
            runs = 2.0 ** (1 - n)
    mu = sum(x) / n
    spread = sum((v - mu) ** 2 for v in x)
    serial = 1.0
    if spread and n > 2:
        r = sum((a - mu) * (b - mu) for a, b in zip(x, x[1:])) / spread
        serial = 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))
    return uniform, min(1.0, runs), min(1.0, serial)


#: share of digits that names with numbers, slugs and paths have at most; twice that share of neighbours differ in character class
ORDINARY_DIGITS = 0.12


def evidence(text: str) -> tuple[float, int] | None:
    """(-log10 p, length) of a candidate: p is the chance that ordinary writing passes for random as this does. None: no candidate.

    A string that the battery rejects as random (Cauchy combination below 0.001) has p = 1. For one that passes, p
    is the chance that ordinary writing would be as mixed: the smaller binomial tail, doubled, of its digits and of its changes
    of character class.
    """
    name = encoding(text)
    if name is None or name == "digits":
        return None
    body = text.rstrip("=")
    ps = battery(text, name)
    combined = sum(math.tan((0.5 - min(max(p, 1e-15), 1 - 1e-15)) * math.pi) for p in ps) / 3
    if 0.5 - math.atan(combined) / math.pi < 0.001:
        return 0.0, len(body)
    n = len(body)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return min(BINS / 10 - 0.1, max(0.0, max(_tail(kinds.count("d"), n, ORDINARY_DIGITS), _tail(changes, n - 1, 2 * ORDINARY_DIGITS)) - math.log10(2))), n


def _tail(k: int, n: int, p: float) -> float:
    """-log10 of the chance of k or more among n."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k, n + 1)]
    top = max(logs)
    return -(top + math.log(sum(math.exp(v - top) for v in logs))) / math.log(10)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, each kind leftmost and non-overlapping; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int, float, int]]:
    """(start, end, -log10 p, length) of the strings that the battery judges."""
    found = []
    for m in CANDIDATE.finditer(text):
        if any(c.isdigit() for c in m[0]):
            e = evidence(m[0])
            if e is not None:
                found.append((m.start(), m.end(), *e))
    return found


def _band(length: int) -> int:
    return int(np.searchsorted(BANDS, length, side="right")) - 1


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_TRIED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("bin", T.IntegerType())]))


def _found(rows: DataFrame) -> DataFrame:
    """``_id``, ``_x`` (hash of the text), ``_base``, ``_tried`` of every row with an ``_id`` and a ``_text``."""
    schema = T.StructType([rows.schema["_id"], T.StructField("_base", _SPANS), T.StructField("_tried", _TRIED)])
    arrow = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("band", pa.int32()), ("bin", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tried = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)])
                tried.append([{"start": a, "end": b, "band": _band(n), "bin": int(e * 10)} for a, b, e, n in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow[0]), pa.array(tried, arrow[1])], names=["_id", "_base", "_tried"])

    return rows.mapInArrow(run, schema)


def discovery_bins(tried: DataFrame, rate: float = RATE) -> list[int]:
    """Per length band, the least bin of -log10 p that Benjamini and Hochberg's step-up rule discovers at ``rate``.

    ``tried``: rows of ``band`` and ``bin``. Counted over all candidates of the corpus; the counts are at most bands times bins
    rows, so the rule itself runs on the driver. The rate is shared among the bands by length: a longer one
    gets more of it, as its tests tell more.
    """
    counts = np.zeros((len(BANDS), BINS + 1))
    for r in tried.groupBy("band", "bin").count().collect():
        counts[r["band"], min(BINS, r["bin"])] += r["count"]
    shares = np.arange(1, len(BANDS) + 1) / sum(range(1, len(BANDS) + 1)) * len(BANDS)
    least = []
    for b in range(len(BANDS)):
        total, at_least = counts[b].sum(), np.cumsum(counts[b][::-1])[::-1]
        p = 10.0 ** (-np.arange(BINS + 1) / 10)
        good = np.flatnonzero((at_least > 0) & (p * total <= at_least * rate * shares[b]))
        least.append(int(good[0]) if len(good) else BINS + 1)
    return least


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``_id``, ``_base`` and ``_spans`` (arrays of kind, start, end in code points, end exclusive) of every row of ``df``.

    ``_spans`` holds the base spans and, of kind ``random``, the candidates that the control discovers and no base span overlaps.
    Null texts count as empty. Repeated rows get equal answers; an empty table gives no rows; other columns are not read.
    """
    rows = pick(df, _id=id_col, _text=text_col).withColumn("_text", F.col("_text").cast("string"))
    found = cut(_found(rows))
    least = discovery_bins(found.select(F.explode("_tried").alias("t")).select("t.band", "t.bin"), rate)
    bound = F.array(*map(F.lit, least))
    fresh = F.filter(
        "_tried",
        lambda t: (t["bin"] >= F.get(bound, t["band"])) & ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    added = F.transform(fresh, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("_id", "_base", F.concat("_base", added).alias("_spans"))


def in_order(spans, kinds: tuple[str, ...]):
    """kind:start:end by start, then kind as listed, joined by commas."""
    order = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("n")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["n"], s["a"].cast("string"), s["e"].cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        F.col("_id").alias("doc_id"),
        *map(count, KINDS),
        F.sha2(in_order(F.col("_base"), KINDS), 256).alias("base_sha256"),
        in_order(F.col("_spans"), (*KINDS, "random")).alias("spans"),
    )
