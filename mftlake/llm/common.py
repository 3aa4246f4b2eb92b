"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def position(df: DataFrame, name: str) -> int:
    """Place of the column called ``name``: an exact match first, then the first that differs in case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    lower = [n.lower() for n in names]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``new=old`` columns of ``df`` alone, whatever else it has and however its names clash."""
    places = {new: position(df, old) for new, old in columns.items()}
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_c{i}").alias(new) for new, i in places.items()))


def packed(df: DataFrame, **columns: str) -> DataFrame:
    """The ``new=old`` columns, and every row whole as the struct ``_row`` (fields ``_c0``, ``_c1``, ...)."""
    places = {new: position(df, old) for new, old in columns.items()}
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    return plain.select(F.struct(*plain.columns).alias("_row"), *(F.col(f"_c{i}").alias(new) for new, i in places.items()))


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows of :func:`packed` with their columns as they were, ``names`` in their order."""
    return rows.select(*(F.col(f"_row._c{i}").alias(f"_c{i}") for i in range(len(names)))).toDF(*names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            found = context._jsc.sc().getCheckpointDir()
        folder = found.get()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and a lost executor costs no work."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut = path
    return table


def append(table: DataFrame, df: DataFrame) -> DataFrame:
    """The table that :func:`cut` wrote, with the rows of ``df`` as well."""
    df.write.mode("append").parquet(table._cut)
    longer = df.sparkSession.read.schema(table.schema).parquet(table._cut)
    longer._cut = table._cut
    return longer


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`cut` wrote and nothing needs any more, and lets Spark drop the shuffle files behind them."""
    for df in tables:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._cut)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)
    gc.collect()
    jvm.System.gc()  # shuffle files go once the plan that made them has been collected


#: rows and bytes that go to a Python worker at a time where a row bears whole texts
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands Python workers BATCH_ROWS rows or about BATCH_BYTES bytes at a time; the session's own settings are back afterwards."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: a key is hot from so many rows on, and from this share of all rows (so at most HOT_KEYS keys are)
HOT_ROWS, HOT_KEYS = 64, 4096


def hot_from(total: int) -> int:
    return max(HOT_ROWS, total // HOT_KEYS + 1)


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """``many`` joined on ``key`` with ``one``, which has every key once and in ``rows`` how many rows of ``many`` have it; ``total`` is their sum.

    Keys with more rows than :func:`hot_from` says, of which there are at most HOT_KEYS, meet their rows where those are; all others shuffle. So
    no task gets more than its share, however many rows one key has.
    """
    limit = hot_from(total)
    hot = F.broadcast(one.filter(F.col(rows) >= limit))
    rest = many.join(F.broadcast(one.filter(F.col(rows) >= limit).select(key)), key, "left_anti")
    return many.join(hot, key).unionByName(rest.join(one.filter(F.col(rows) < limit), key))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; everything else stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
