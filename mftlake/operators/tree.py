"""Directories: lookups by name, listings, paths, whole-volume search.

Operators take relations, not images. Entries: ``image``, ``dir_ref``, ``file_ref``, ``name``, ``namespace``, ``is_dir``, ``size``,
``flags``, ``ts``. Nodes: ``image``, ``ref``, ``name`` and, where paths are climbed, ``parent`` (null: none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mftlake import constants as C
from mftlake.functions import exprs as X


def listed(entries: DataFrame) -> DataFrame:
    """Entries that a listing shows: user files under a Win32 name."""
    return entries.filter((F.col("file_ref") >= C.FIRST_USER) & X.is_win32_name(F.col("name"), F.col("namespace")))


def list_directory(entries: DataFrame, directory: Column | None = None) -> DataFrame:
    """Lines of a listing of one directory (a predicate on ``dir_ref``) or of all; sort by ``upper(name), name`` to show it."""
    rows = entries if directory is None else entries.filter(directory)
    return listed(rows).select(
        "image", "dir_ref", "file_ref", "name", "is_dir", F.when(F.col("is_dir"), F.lit(None)).otherwise(F.col("size")).alias("size"), X.rhs(F.col("flags")).alias("attributes"), X.format_time(F.col("ts")).alias("time")
    )


def ordered_listing(entries: DataFrame) -> DataFrame:
    """Entries with their ``place`` (from 1) in the collated order of their directory, which is how its index tree is walked: by name, cases aside."""
    order = Window.partitionBy("image", "dir_ref").orderBy(F.upper("name"), "name", "file_ref")
    return entries.select("image", "dir_ref", "file_ref", "name", F.row_number().over(order).cast("bigint").alias("place"))


def live_references(records: DataFrame) -> DataFrame:
    """Numbers of the records in use, each once and in order."""
    return records.filter("in_use").select("image", "record_no").distinct().orderBy("image", "record_no")


def count_entries(entries: DataFrame) -> DataFrame:
    """Files and directories of every listing."""
    return listed(entries).groupBy("image", "dir_ref").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if(F.col("is_dir")).alias("directories"))


def find_entry(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``image``, ``dir_ref``, ``component``) with ``file_ref`` and ``is_dir`` of the entry of that name, cases aside; first of several by reference."""
    named = entries.groupBy("image", "dir_ref", F.lower("name").alias("_name")).agg(F.min_by(F.struct("file_ref", "is_dir"), "file_ref").alias("_hit"))
    joined = wanted.withColumn("_name", F.lower("component")).join(named, ["image", "dir_ref", "_name"], "left")
    return joined.select(*wanted.columns, F.col("_hit.file_ref").alias("file_ref"), F.col("_hit.is_dir").alias("is_dir"))


def resolve_paths(entries: DataFrame, paths: DataFrame, depth: int, path_col: str = "path") -> DataFrame:
    """``paths`` (with ``image``) and the reference each leads to from the root; null where a component is missing or no directory.

    One equi-join on (directory, folded name) per component, up to ``depth``; longer paths lead nowhere.
    """
    at = paths.withColumn("_parts", X.path_parts(F.col(path_col))).withColumn("_ref", F.lit(C.ROOT).cast("bigint")).withColumn("_dir", F.lit(True))
    named = entries.groupBy("image", F.col("dir_ref").alias("_at"), F.lower("name").alias("_name")).agg(F.min_by(F.struct("file_ref", "is_dir"), "file_ref").alias("_hit"))
    for i in range(depth):
        step = F.get("_parts", F.lit(i))
        keyed = at.withColumn("_at", F.when(F.col("_dir") & step.isNotNull(), F.col("_ref"))).withColumn("_name", F.lower(step))
        at = keyed.join(named, ["image", "_at", "_name"], "left").select(
            *at.columns[:-2],
            F.when(step.isNull(), F.col("_ref")).otherwise(F.col("_hit.file_ref")).alias("_ref"),
            F.when(step.isNull(), F.col("_dir")).otherwise(F.coalesce("_hit.is_dir", F.lit(False))).alias("_dir"),
        )
    return at.select(*paths.columns, F.when(F.size("_parts") <= depth, F.col("_ref")).alias("ref"))


def parent_map(entries: DataFrame) -> DataFrame:
    """The one parent of every file: the first directory that has it, its own entry aside."""
    return entries.filter("file_ref <> dir_ref").groupBy("image", F.col("file_ref").alias("ref")).agg(F.min("dir_ref").alias("parent"))


def _climbed(start: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``start`` (``image``, ``ref``, ``parent``, ``path``) climbed by ``depth`` levels, which also ends cycles of corrupt parents; rows whose parent is not known stay as they are."""
    up = nodes.select(F.col("image").alias("_image"), F.col("ref").alias("_ref"), F.col("name").alias("_name"), F.col("parent").alias("_up"))
    for _ in range(depth):
        start = start.join(up, (F.col("image") == F.col("_image")) & (F.col("parent") == F.col("_ref")), "left").select(
            *(c for c in start.columns if c not in ("parent", "path")),
            F.col("_up").alias("parent"),
            F.when(F.col("_name").isNotNull(), F.concat("_name", F.lit("\\"), "path")).otherwise(F.col("path")).alias("path"),
        )
    return start.drop("parent")


def full_paths(nodes: DataFrame, depth: int) -> DataFrame:
    """``path`` of every node by its parents, names joined by backslashes; ``depth`` bounds the climb, a missing parent leaves a partial path."""
    return _climbed(nodes.select("image", "ref", "parent", F.col("name").alias("path")), nodes, depth)


def search(nodes: DataFrame, pattern: str | None, depth: int, limit: int = 5000, state: Column | None = None) -> DataFrame:
    """Nodes whose name a regular expression matches whole, by reference, at most ``limit``, with path and time.

    The leaf's name and ``state`` (a predicate, such as live or deleted) decide before anything is climbed, and the limit
    is taken first, so that only what is shown meets the tree.
    """
    hits = nodes.filter(X.matches_whole(F.col("name"), pattern))
    if state is not None:
        hits = hits.filter(state)
    first = hits.select("image", "ref", "parent", F.col("name").alias("path"), "ts").orderBy("image", "ref").limit(limit)
    found = _climbed(first, nodes, depth)
    return found.select("image", "ref", "path", X.format_time(F.col("ts")).alias("time"))


def directory_entries(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries with the record that each refers to; ``stale`` where the record's sequence number has moved on."""
    there = records.select("image", F.col("record_no").alias("file_ref"), "seq_no", "in_use")
    joined = entries.join(there, ["image", "file_ref"], "left")
    return joined.withColumn("stale", F.coalesce(F.col("seq_no") != F.col("file_seq"), F.lit(True)))
