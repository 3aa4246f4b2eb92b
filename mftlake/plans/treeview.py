"""The driver tables seen as the relations of a volume.

Regions, nations and customers are directories of three levels, orders are files; reference bases keep them apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION, NATION, CUSTOMER, ORDER = 16, 100, 1_000, 1_000_000_000_000
#: levels from a file up to the root
DEPTH = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entry(parent: Column, ref: Column, name: Column, directory: bool, size: Column, flags: Column, namespace: Column, ts: Column) -> list[Column]:
    return [
        F.lit("driver").alias("image"),
        parent.cast("bigint").alias("dir_ref"),
        ref.cast("bigint").alias("file_ref"),
        name.alias("name"),
        namespace.cast("int").alias("namespace"),
        F.lit(directory).alias("is_dir"),
        size.cast("bigint").alias("size"),
        flags.cast("int").alias("flags"),
        ts.cast("timestamp").alias("ts"),
    ]


def order_flags() -> Column:
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    return bit(F.col("o_orderpriority").startswith("1"), 1) + bit(F.col("o_orderstatus") == "P", 2) + bit(F.col("o_orderstatus") == "O", 4)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, zero = F.lit(None).cast("timestamp"), F.lit(0)
    parts = [
        table(spark, sf_dir, "region").select(_entry(F.lit(5), F.col("r_regionkey") + REGION, F.col("r_name"), True, zero, zero, F.lit(1), none)),
        table(spark, sf_dir, "nation").select(_entry(F.col("n_regionkey") + REGION, F.col("n_nationkey") + NATION, F.col("n_name"), True, zero, zero, F.lit(1), none)),
        table(spark, sf_dir, "customer").select(_entry(F.col("c_nationkey") + NATION, F.col("c_custkey") + CUSTOMER, F.col("c_name"), True, zero, zero, F.lit(1), none)),
        table(spark, sf_dir, "orders").select(
            _entry(F.col("o_custkey") + CUSTOMER, F.col("o_orderkey") + ORDER, F.concat(F.lit("order"), F.col("o_orderkey").cast("string")), False, F.floor("o_totalprice"), order_flags(), F.col("o_orderkey") % 4, F.col("o_orderdate"))
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as nodes with a parent; the root itself is not named in paths."""
    return entries(spark, sf_dir).select("image", F.col("file_ref").alias("ref"), "name", F.col("dir_ref").alias("parent"), "ts", "is_dir")


_FLAGS = "CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 4 ELSE 0 END"

#: the same relation for DuckDB, as a common table expression called ``entries``
ENTRIES_SQL = f"""
entries AS (
  SELECT CAST(5 AS BIGINT) AS dir_ref, CAST(r_regionkey + {REGION} AS BIGINT) AS file_ref, r_name AS name, 1 AS namespace, true AS is_dir,
         CAST(0 AS BIGINT) AS size, 0 AS flags, CAST(NULL AS TIMESTAMP) AS ts FROM region
  UNION ALL
  SELECT CAST(n_regionkey + {REGION} AS BIGINT), CAST(n_nationkey + {NATION} AS BIGINT), n_name, 1, true, 0, 0, NULL FROM nation
  UNION ALL
  SELECT CAST(c_nationkey + {NATION} AS BIGINT), CAST(c_custkey + {CUSTOMER} AS BIGINT), c_name, 1, true, 0, 0, NULL FROM customer
  UNION ALL
  SELECT o_custkey + {CUSTOMER}, o_orderkey + {ORDER}, 'order' || CAST(o_orderkey AS VARCHAR), CAST(o_orderkey % 4 AS INTEGER), false,
         CAST(floor(o_totalprice) AS BIGINT), {_FLAGS}, CAST(o_orderdate AS TIMESTAMP) FROM orders
)"""
FLAGS_SQL = _FLAGS
