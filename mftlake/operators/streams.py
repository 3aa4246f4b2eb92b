"""Extents, streams, bitmaps.

Runs: ``image``, ``record_no``, ``attr``, ``run_no``, ``clusters``, ``delta`` (0: sparse).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mftlake.functions import exprs as X

ATTRIBUTE = ["image", "record_no", "attr"]


def place_runs(runs: DataFrame, start_vcn: str | None = None) -> DataFrame:
    """Virtual and logical cluster numbers of runs by running sums; ``lcn`` is null for sparse runs and ``valid`` false from the first negative one on.

    ``start_vcn``: column with the virtual cluster at which the attribute's extent begins (continuations do not begin at 0).
    """
    order = Window.partitionBy(*ATTRIBUTE).orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("clusters").over(order) + (F.col(start_vcn) if start_vcn else F.lit(0))
    rows = runs.withColumn("_end", end).withColumn("_lcn", F.sum("delta").over(order))
    rows = rows.withColumn("valid", F.min("_lcn").over(order) >= 0)
    return rows.select(
        *ATTRIBUTE, "run_no", "clusters", (F.col("_end") - F.col("clusters")).alias("start_vcn"), (F.col("_end") - 1).alias("last_vcn"), F.when(F.col("delta") != 0, F.col("_lcn")).alias("lcn"), "valid"
    )


def locate(requests: DataFrame, placed: DataFrame) -> DataFrame:
    """``requests`` (attribute, ``vcn``) with the run that holds each cluster and its logical cluster; null where sparse or beyond the extents.

    The attribute is an equality key, so the range condition runs within one attribute's runs.
    """
    runs = placed.select(*(F.col(c).alias(f"_{c}") for c in (*ATTRIBUTE, "start_vcn", "last_vcn", "lcn", "run_no")))
    same = [F.col(c) == F.col(f"_{c}") for c in ATTRIBUTE]
    joined = requests.join(runs, [*same, F.col("vcn").between(F.col("_start_vcn"), F.col("_last_vcn"))], "left")
    return joined.select(*requests.columns, F.col("_run_no").alias("run_no"), (F.col("_lcn") + F.col("vcn") - F.col("_start_vcn")).alias("lcn"))


def read_tasks(placed: DataFrame, clusters_at_once: int = 256) -> DataFrame:
    """Pieces of runs of at most ``clusters_at_once`` clusters: ``vcn``, ``lcn``, ``count``; what a distributed read deals out."""
    step = F.explode(F.expr(f"sequence(0L, clusters - 1, {clusters_at_once}L)")).alias("_off")
    rows = placed.filter("clusters > 0 and valid").select("*", step)
    count = F.least(F.lit(clusters_at_once), F.col("clusters") - F.col("_off"))
    return rows.select(*ATTRIBUTE, (F.col("start_vcn") + F.col("_off")).alias("vcn"), (F.col("lcn") + F.col("_off")).alias("lcn"), count.alias("count"))


def read_range(streams: DataFrame, offset: str = "offset", length: str = "length") -> DataFrame:
    """``streams`` (``bytes``) with ``part``, the byte range clamped to the end; null where it starts beyond."""
    return streams.withColumn("part", X.slice_bytes(F.col("bytes"), F.col(offset), F.col(length)))


def chunks(streams: DataFrame, size: int = 65_536) -> DataFrame:
    """``bytes`` in pieces of ``size``: ``chunk_no`` from 0; no piece for an empty stream."""
    n = F.octet_length("bytes")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.expr(f"(octet_length(bytes) - 1) div {size}"))).otherwise(F.array().cast("array<bigint>"))).alias("chunk_no")
    rows = streams.select("*", at)
    part = F.substring("bytes", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size))
    return rows.withColumn("bytes", part)


def find_stream(attributes: DataFrame, name: str | None = None, data_slot: int = 7) -> DataFrame:
    """The first DATA attribute of the name in every record that has one; None stands for the unnamed stream."""
    rows = attributes.filter((F.col("slot") == data_slot) & (F.coalesce("name", F.lit("")) == (name or "")))
    return rows.groupBy("image", "record_no").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("image", "record_no"))), "ord").alias("_first")).select("image", "record_no", "_first.*")


def hexdump(streams: DataFrame, key: str, limit: int = 16_384) -> DataFrame:
    """Lines of the hex dump of the first ``limit`` bytes of each stream."""
    rows = streams.select(key, "bytes", F.explode(X.line_offsets(F.col("bytes"), limit)).alias("_at"))
    offset, text, letters = X.hex_line(F.col("bytes"), F.col("_at"), limit)
    return rows.select(key, F.expr("_at div 16").alias("line_no"), offset.alias("offset"), text.alias("hex"), letters.alias("ascii"))


def clusters_free(requests: DataFrame, bitmap: DataFrame) -> DataFrame:
    """``requests`` (``image``, ``cluster``) with ``free``; ``bitmap``: ``image``, ``byte_no``, ``b``."""
    keyed = requests.withColumn("byte_no", F.expr("cluster div 8"))
    return keyed.join(bitmap.select("image", "byte_no", "b"), ["image", "byte_no"], "left").withColumn("free", X.cluster_free(F.col("b"), F.col("cluster"))).drop("byte_no", "b")


def free_space(bitmap: DataFrame, cluster_size: int) -> DataFrame:
    """Free and used clusters and free bytes of every image, by the number of set bits."""
    used = F.sum(F.bit_count(F.col("b").bitwiseAND(F.lit(255))))
    return bitmap.groupBy("image").agg((F.count("*") * 8 - used).cast("bigint").alias("free_clusters"), used.cast("bigint").alias("used_clusters")).withColumn("free_bytes", F.col("free_clusters") * cluster_size)
