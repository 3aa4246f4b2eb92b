"""Relations of a volume: raw records in, typed DataFrames out.

Record predicates and attribute masks go in here, before anything is decoded: Spark cannot push them through the
decoders, which are Arrow batch functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mftlake import constants as C
from mftlake.functions import exprs as X
from mftlake.operators import attributes as A
from mftlake.operators import streams as S
from mftlake.sources import decode as D
from mftlake.sources import ntfs

VOLUME = "image string, sector_size int, cluster_size bigint, record_size bigint, index_block_size bigint, mft_addr bigint, ver_major int, ver_minor int, volume_name string, records bigint, ok boolean, status string"
RECORD = "image string, record_no bigint, status string, seq_no int, hardlinks int, flags int, in_use boolean, is_dir boolean, attr_offset int, real_size bigint, alloc_size bigint, base_ref bigint, lsn decimal(20,0), patched binary"
ATTRIBUTE = "image string, record_no bigint, ord int, status string, type int, slot int, attr_id int, name string, flags int, non_resident boolean, total_size bigint, body binary, start_vcn bigint, last_vcn bigint, alloc_size bigint, data_size bigint, ini_size bigint, runs binary"
NAME = "parent_ref bigint, parent_seq int, create_ft bigint, alter_ft bigint, mft_ft bigint, read_ft bigint, alloc_size bigint, real_size bigint, flags bigint, namespace int, name string, name_raw binary"
ENTRY = f"image string, dir_ref bigint, node_vcn bigint, ord int, file_ref bigint, file_seq int, entry_flags int, sub_vcn bigint, {NAME}"


def _map(df: DataFrame, schema: str, rows: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """One Arrow batch function that turns every row into some rows of ``schema``; batches of output stay small."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                out.extend(rows(row))
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, kind)


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """Geometry, version and status of the volumes that a path or glob names."""
    rows = [
        (v.image, v.geometry.sector_size, v.geometry.cluster_size, v.geometry.record_size, v.geometry.index_block_size, v.geometry.mft_addr, *v.version, v.name, v.records, v.status == "ok", v.status)
        for v in ntfs.open_volumes(path)
    ]
    return spark.createDataFrame(rows, VOLUME)


def numbered(attributes: DataFrame) -> Column:
    """A number for each attribute of a record: its place, and where it was moved in from another record, that record's number before it."""
    place = F.col("ord").cast("bigint")
    return F.when(F.col("src_record_no") != F.col("record_no"), F.col("src_record_no") * 65_536 + place).otherwise(place) if "src_record_no" in attributes.columns else place


class Image:
    """The relations of the volumes that ``path`` names.

    ``records``: a predicate on ``record_no`` that the scan itself applies. ``mask``: attribute slots that are decoded;
    standard information and attribute lists always are, as other relations need them.
    """

    def __init__(self, spark: SparkSession, path: str, records_per_partition: int = 65_536):
        ntfs.register(spark)
        self.spark, self.path, self.step = spark, path, records_per_partition
        self.found = {v.image: v for v in ntfs.open_volumes(path)}

    def volumes(self) -> DataFrame:
        return volumes(self.spark, self.path)

    def raw(self, records: Column | None = None) -> DataFrame:
        df = self.spark.read.format("ntfs").option("recordsPerPartition", self.step).load(self.path)
        return df if records is None else df.filter(records)

    def records(self, records: Column | None = None) -> DataFrame:
        sector = {i: v.geometry.sector_size for i, v in self.found.items()}

        def rows(r: dict) -> Iterable[dict]:
            found = D.record(r["raw"], r["record_no"], sector[r["image"]])
            row = {"image": r["image"], "record_no": r["record_no"], "status": found.status} | found.fields
            if found.status == "ok":
                row |= {"in_use": bool(row["flags"] & C.IN_USE), "is_dir": bool(row["flags"] & C.IS_DIRECTORY), "patched": found.raw}
            return [row]

        def run(r: dict) -> Iterable[dict]:
            from decimal import Decimal

            for row in rows(r):
                yield row | ({"lsn": Decimal(row["lsn"])} if "lsn" in row else {})

        return _map(self.raw(records), RECORD, run)

    def own_attributes(self, records: Column | None = None, mask: int = C.MASK_ALL) -> DataFrame:
        """Attributes as they stand in each record."""
        wanted = mask | 0b11

        def rows(r: dict) -> Iterable[dict]:
            for a in D.attributes(r["patched"], r["attr_offset"], wanted):
                yield {"image": r["image"], "record_no": r["record_no"]} | a

        return _map(self.records(records).filter("status = 'ok'").select("image", "record_no", "attr_offset", "patched"), ATTRIBUTE, rows)

    def list_items(self, attributes: DataFrame) -> DataFrame:
        """Items of attribute lists, resident or not."""
        schema = "image string, record_no bigint, ord int, type bigint, slot int, name string, start_vcn bigint, target_ref bigint, target_seq int, attr_id int"
        lists = self.stream_bytes(attributes.filter("slot = 1 and status = 'ok'"))
        return _map(lists.select("image", "record_no", "bytes"), schema, lambda r: ({"image": r["image"], "record_no": r["record_no"]} | i for i in D.attribute_list(r["bytes"])))

    def attributes(self, mask: int = C.MASK_ALL) -> DataFrame:
        """Attributes by the record that owns them: those in extension records belong to the base record whose list names them."""
        own = self.own_attributes(mask=mask)
        items = self.list_items(self.own_attributes(mask=0b10))
        return A.merge_lists(own, items.select("image", "record_no", "target_ref", "slot"))

    def data_runs(self, attributes: DataFrame) -> DataFrame:
        """Extents of non-resident attributes with their clusters; continuations begin at their own first cluster."""
        coded = attributes.filter("non_resident and status = 'ok'").select("image", "record_no", numbered(attributes).alias("attr"), "start_vcn", "runs")
        return S.place_runs(decode_runs(coded.withColumnRenamed("start_vcn", "from_vcn")), "from_vcn")

    def read_clusters(self, placed: DataFrame) -> DataFrame:
        """Bytes of placed runs by ``vcn``, read on the executors; sparse runs are zeros and touch no disk."""
        sizes = {i: v.geometry.cluster_size for i, v in self.found.items()}
        schema = "image string, record_no bigint, attr bigint, vcn bigint, bytes binary"

        def rows(r: dict) -> Iterable[dict]:
            length = r["count"] * sizes[r["image"]]
            data = bytes(length) if r["lcn"] is None else ntfs.reader(r["image"])(r["lcn"] * sizes[r["image"]], length)
            yield {k: r[k] for k in ("image", "record_no", "attr", "vcn")} | {"bytes": data.ljust(length, b"\0")}

        return _map(S.read_tasks(placed), schema, rows)

    def stream_chunks(self, attributes: DataFrame) -> DataFrame:
        """Bytes of attributes in pieces: ``image``, ``record_no``, ``attr``, ``slot``, ``name``, ``at`` (byte offset), ``bytes``, cut at the real size, zeros past the initialised one.

        Extents of one stream that stand in several records or attributes make one stream by record, type and name.
        """
        sizes = {i: v.geometry.cluster_size for i, v in self.found.items()}
        cluster = F.create_map(*(F.lit(x) for p in sizes.items() for x in p)) if sizes else F.create_map(F.lit(""), F.lit(1))
        resident = attributes.filter("not non_resident and status = 'ok'").select("image", "record_no", numbered(attributes).alias("attr"), "slot", "name", F.lit(0).cast("bigint").alias("at"), F.col("body").alias("bytes"))
        outer = attributes.filter("non_resident and status = 'ok'").withColumn("attr", numbered(attributes))
        read = self.read_clusters(self.data_runs(attributes))
        # only the first extent's header has the sizes of the whole
        head = outer.groupBy("image", "record_no", "slot", "name").agg(F.max("data_size").alias("_size"), F.max("ini_size").alias("_ini"))
        named = outer.select("image", "record_no", "attr", "slot", "name").join(head, ["image", "record_no", "slot", "name"])
        rows = read.join(named, ["image", "record_no", "attr"]).withColumn("at", F.col("vcn") * cluster[F.col("image")])
        rows = rows.filter(F.col("at") < F.col("_size"))
        real = F.least(F.octet_length("bytes").cast("bigint"), F.col("_size") - F.col("at"))
        good = F.greatest(F.lit(0), F.least(real, F.col("_ini") - F.col("at")))
        shown = F.concat(F.substring("bytes", F.lit(1), good.cast("int")), F.unhex(F.repeat(F.lit("00"), (real - good).cast("int"))))
        return resident.unionByName(rows.select("image", "record_no", "attr", "slot", "name", "at", shown.alias("bytes")))

    def stream_bytes(self, attributes: DataFrame) -> DataFrame:
        """Whole streams: ``image``, ``record_no``, ``slot``, ``name``, ``bytes``; for small ones, such as lists and directories."""
        joined = self.stream_chunks(attributes).groupBy("image", "record_no", "slot", "name").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("_c"))
        return joined.select("image", "record_no", "slot", "name", F.aggregate("_c", F.lit(b""), lambda s, c: F.concat(s, c["bytes"])).alias("bytes"))

    def standard_information(self, attributes: DataFrame) -> DataFrame:
        schema = "image string, record_no bigint, ord int, create_ft bigint, alter_ft bigint, mft_ft bigint, read_ft bigint, permission bigint, owner_id bigint, security_id bigint, quota bigint, usn bigint"
        return _map(attributes.filter("slot = 0 and status = 'ok'").select("image", "record_no", "ord", "body"), schema, lambda r: [{k: r[k] for k in ("image", "record_no", "ord")} | D.standard_information(r["body"])])

    def file_names(self, attributes: DataFrame) -> DataFrame:
        def rows(r: dict) -> Iterable[dict]:
            name = D.file_name(r["body"])
            return [{k: r[k] for k in ("image", "record_no", "ord")} | name] if name else []

        return _map(attributes.filter("slot = 2 and status = 'ok'").select("image", "record_no", "ord", "body"), f"image string, record_no bigint, ord int, {NAME}", rows)

    def index_entries(self, attributes: DataFrame) -> DataFrame:
        """Entries of all directories: those of root nodes, and those of every block of the allocation; bad blocks have none."""
        roots = attributes.filter("slot = 8 and status = 'ok' and not non_resident").select("image", "record_no", "body")
        top = _map(roots, ENTRY, lambda r: ({"image": r["image"], "dir_ref": r["record_no"]} | e for e in D.index_root(r["body"])))
        geometry = {i: v.geometry for i, v in self.found.items()}

        def blocks(r: dict) -> Iterable[dict]:
            g = geometry[r["image"]]
            unit = g.cluster_size if g.cluster_size <= g.index_block_size else 512
            for at in range(0, len(r["bytes"]) - g.index_block_size + 1, g.index_block_size):
                for e in D.index_block(r["bytes"][at : at + g.index_block_size], g.sector_size)[0]:
                    yield {"image": r["image"], "dir_ref": r["record_no"], "node_vcn": at // unit} | e

        below = _map(self.stream_bytes(attributes.filter("slot = 9")).filter("name = '$I30'").select("image", "record_no", "bytes"), ENTRY, blocks)
        return top.unionByName(below)

    def bitmap(self, attributes: DataFrame) -> DataFrame:
        """Bytes of the volume's allocation bitmap (the unnamed stream of record 6): ``image``, ``byte_no``, ``b``."""
        chunks = self.stream_chunks(attributes.filter((F.col("record_no") == C.BITMAP_FILE) & (F.col("slot") == 7) & (F.col("name") == "")))
        schema = "image string, byte_no bigint, b int"
        return _map(chunks.select("image", "at", "bytes"), schema, lambda r: ({"image": r["image"], "byte_no": r["at"] + i, "b": b} for i, b in enumerate(r["bytes"])))

    def entries(self, attributes: DataFrame) -> DataFrame:
        """Directory entries in the form that :mod:`mftlake.operators.tree` takes."""
        return self.index_entries(attributes).select(
            "image", "dir_ref", "file_ref", "file_seq", "name", "namespace", X.has_flag(F.col("flags"), C.NAME_DIRECTORY).alias("is_dir"), F.col("real_size").alias("size"), "flags", X.from_filetime(F.col("alter_ft")).alias("ts")
        )

    def nodes(self, attributes: DataFrame) -> DataFrame:
        """Every readable record with its first name, its one parent and its time, in the form that a search takes."""
        records = self.records().filter("status = 'ok'").select("image", F.col("record_no").alias("ref"), "in_use", "is_dir")
        names = A.first_name(self.file_names(attributes)).select("image", F.col("record_no").alias("ref"), "name")
        times = self.standard_information(attributes).groupBy("image", F.col("record_no").alias("ref")).agg(F.min_by("alter_ft", "ord").alias("alter_ft"))
        live = records.filter("in_use and is_dir").select("image", F.col("ref").alias("dir_ref"))
        from mftlake.operators import tree

        parents = tree.parent_map(self.entries(attributes).join(live, ["image", "dir_ref"]))
        return records.join(names, ["image", "ref"]).join(parents, ["image", "ref"], "left").join(times, ["image", "ref"], "left").withColumn("ts", X.from_filetime(F.coalesce("alter_ft", F.lit(0)))).drop("alter_ft")


def decode_runs(coded: DataFrame) -> DataFrame:
    """Runs of coded extents (``runs``, with the attribute's keys and any other columns but it): ``run_no``, ``clusters``, ``delta``, ``run_status``."""
    kept = [f for f in coded.schema.fields if f.name != "runs"]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("run_no", "clusters", "delta")), T.StructField("run_status", T.StringType())])

    def rows(r: dict) -> Iterable[dict]:
        found, status = D.runs(r["runs"])
        for i, (clusters, delta) in enumerate(found):
            yield {f.name: r[f.name] for f in kept} | {"run_no": i, "clusters": clusters, "delta": delta, "run_status": status}

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for row in batch.to_pylist() for x in rows(row)], arrow)

    return coded.mapInArrow(run, schema)
