"""Attributes of records: masks, callbacks, traversal, lists, first values.

Attributes: ``image``, ``record_no``, ``ord``, ``slot``, ``name`` and whatever else a caller carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mftlake.functions import exprs as X

RECORD = ["image", "record_no"]


def masked(attributes: DataFrame, mask: int) -> DataFrame:
    """Attributes whose slot is in the mask."""
    return attributes.filter(X.in_mask(F.col("slot"), mask))


def of_type(attributes: DataFrame, slot: int) -> DataFrame:
    return attributes.filter(F.col("slot") == slot)


def keep(attributes: DataFrame, record_discard: Column | None = None, volume_discard: Column | None = None) -> DataFrame:
    """Attributes that no callback discards; a record's own callback comes before the volume's, null from it leaves it to that."""
    said = [c for c in (record_discard, volume_discard) if c is not None]
    return attributes.filter(~F.coalesce(*said, F.lit(False)))


def traverse(attributes: DataFrame, mask: int, stop: Column | None = None) -> DataFrame:
    """Attributes in the mask with ``visit``, their place in slot order, up to and with the first for which ``stop`` holds."""
    order = Window.partitionBy(*RECORD).orderBy("slot", "ord")
    rows = masked(attributes, mask).withColumn("visit", F.row_number().over(order))
    if stop is None:
        return rows
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(before), F.lit(0))
    return rows.withColumn("_stopped", stopped).filter("_stopped = 0").drop("_stopped")


def merge_lists(attributes: DataFrame, items: DataFrame) -> DataFrame:
    """Own attributes and those that lists move in from other records; an attribute listed twice moves once.

    ``items``: ``image``, ``record_no`` (the owner), ``target_ref``, ``slot``. Result: ``src_record_no`` says where each stood.
    """
    own = attributes.withColumn("src_record_no", F.col("record_no"))
    wanted = items.filter("target_ref <> record_no").select("image", F.col("record_no").alias("_owner"), F.col("target_ref").alias("record_no"), "slot").distinct()
    moved = attributes.join(wanted, [*RECORD, "slot"]).withColumn("src_record_no", F.col("record_no")).withColumn("record_no", F.col("_owner"))
    return own.unionByName(moved.select(own.columns))


def first_name(names: DataFrame) -> DataFrame:
    """First Win32 name of every record that has one."""
    rows = names.filter(X.is_win32_name(F.col("name"), F.col("namespace")))
    return rows.groupBy(*RECORD).agg(F.min_by("name", "ord").alias("name"))


def first_sizes(records: DataFrame, names: DataFrame) -> DataFrame:
    """Real size by the first name of every record; none: 0."""
    first = names.groupBy(*RECORD).agg(F.min_by("real_size", "ord").alias("size"))
    return records.select(*RECORD).join(first, RECORD, "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))


def record_flags(records: DataFrame, information: DataFrame) -> DataFrame:
    """What a record's header and its first standard information say; without one, every permission is false."""
    first = information.groupBy(*RECORD).agg(F.min_by("permission", "ord").alias("_p"))
    joined = records.join(first, RECORD, "left")
    bits = {"read_only": 0x1, "hidden": 0x2, "system": 0x4, "sparse": 0x200, "compressed": 0x800, "encrypted": 0x4000}
    return joined.select(
        *RECORD, X.is_deleted(F.col("flags")).alias("deleted"), X.is_directory(F.col("flags")).alias("directory"), *(X.has_flag(F.col("_p"), bit).alias(n) for n, bit in bits.items())
    )


#: flags of a file name by bit, as the format has them (fixed values)
NAME_FLAGS = {
    "read_only": 0x1,
    "hidden": 0x2,
    "system": 0x4,
    "archive": 0x20,
    "device": 0x40,
    "normal": 0x80,
    "temporary": 0x100,
    "sparse": 0x200,
    "reparse_point": 0x400,
    "compressed": 0x800,
    "offline": 0x1000,
    "not_indexed": 0x2000,
    "encrypted": 0x4000,
    "directory": 0x10000000,
}


def name_flags(names: DataFrame) -> DataFrame:
    """What the ``flags`` of every file name say, one boolean each; false where there are no flags."""
    return names.select(*RECORD, "ord", *(X.has_flag(F.col("flags"), bit).alias(n) for n, bit in NAME_FLAGS.items()))


TIMES = "create_ft", "alter_ft", "mft_ft", "read_ft"


def first_times(records: DataFrame, information: DataFrame) -> DataFrame:
    """The four times of every record's first standard information; without one, 0."""
    first = information.groupBy(*RECORD).agg(F.min_by(F.struct(*TIMES), "ord").alias("_t"))
    joined = records.select(*RECORD).join(first, RECORD, "left")
    return joined.select(*RECORD, *(F.coalesce(F.col(f"_t.{n}"), F.lit(0).cast("bigint")).alias(n) for n in TIMES))


def dump(attributes: DataFrame) -> DataFrame:
    """Lines of an attribute dump: label and hex of each attribute's bytes (``body``), in slot order."""
    rows = attributes.withColumn("label", X.attribute_label(F.col("slot"), F.col("name")))
    lines = F.posexplode_outer(X.attribute_hex_lines(F.coalesce("body", F.lit(b""))))
    return rows.select(*RECORD, "slot", "ord", "label", lines.alias("line_no", "line")).select(*RECORD, "slot", "ord", "label", "line_no", "line.hex", "line.ascii")
