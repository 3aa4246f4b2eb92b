"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, packed, read, unpacked

DIGEST = ["_sha", "_bytes", "_check"]


def _address(at: Column, depth: int, fanout: int) -> Column:
    """Where a run goes in round ``depth``: the lowest digits of its address become those of the digest."""
    span = fanout**depth
    return (F.floor(at / F.lit(span)) * F.lit(span) + F.pmod(F.xxhash64("_sha"), F.lit(span))).cast("int")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fanout: int = 16, rounds: int = 2, keep: str = "max") -> DataFrame:
    """Every row of ``df`` with the row that stays for its text.

    Rows are dealt by their identifier over ``fanout ** rounds`` addresses (choose at least as many as there are cores). Each makes a
    sorted run with one entry per digest, and the runs are written once. In every round the addresses that differ in one digit
    exchange those parts of their runs that the digest's digit assigns to the other, and merge the ``fanout``
    runs they then hold: equal digests lie side by side in the sorted rows, which a sort aggregate joins as it passes. So a
    digest with a third of all rows never has more than ``fanout`` entries in one merge. An entry is the digest, verified by the length and a second
    hash of the text, the best identifier and the number of rows. The answers go back down the same tree, so
    the join with the rows is spread over the first partitions too.

    Result: ``_row`` (the whole row), ``_id``, ``_sha`` (binary), ``_keep``, ``_size``, ``_kept``. Null text counts as empty.
    A null identifier is smaller than any other. Of rows that repeat both text and the kept identifier, one is kept.
    An empty table gives an empty result; other columns travel in ``_row``, whatever they are called.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    rows = (
        packed(df, _id=id_col, _text=text_col)
        .select(
            "_row",
            "_id",
            F.pmod(F.xxhash64("_id"), F.lit(fanout**rounds)).cast("int").alias("_at"),
            F.unhex(F.sha2(text, 256)).alias("_sha"),
            F.octet_length(text).alias("_bytes"),
            F.xxhash64(text).alias("_check"),
        )
    )
    # every address holds one run, sorted by digest; a round sends its parts on by address alone and merges what then lies together
    run = lambda df: df.repartition("_at").sortWithinPartitions("_at", *DIGEST)
    first = run(rows.groupBy("_at", *DIGEST).agg(best(F.struct("_id")).alias("_best"), F.count("*").alias("_n")))
    levels = [cut(first)]
    for depth in range(1, rounds + 1):
        moved = run(levels[-1].withColumn("_at", _address(F.col("_at"), depth, fanout)))
        levels.append(moved.groupBy("_at", *DIGEST).agg(best("_best").alias("_best"), F.sum("_n").alias("_n")))
    answer = levels[-1]
    for depth in range(rounds, 0, -1):
        below = levels[depth - 1].select(F.col("_at").alias("_down"), _address(F.col("_at"), depth, fanout).alias("_at"), *DIGEST)
        answer = below.join(answer, ["_at", *DIGEST]).drop("_at").withColumnRenamed("_down", "_at")
    repeat = F.row_number().over(Window.partitionBy("_at", *DIGEST, "_id").orderBy(F.lit(0)))
    return rows.join(answer, ["_at", *DIGEST]).select(
        "_row",
        "_id",
        "_sha",
        F.col("_best._id").alias("_keep"),
        F.col("_n").alias("_size"),
        (F.col("_id").eqNullSafe(F.col("_best._id")) & (repeat == 1)).alias("_kept"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with its columns; see :func:`exact_groups`."""
    return unpacked(exact_groups(df, id_col, text_col, **options).filter("_kept"), df.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
