"""``spark.read.format("ntfs")``: raw file records of volume images, read in parallel, pruned by record number."""

from __future__ import annotations

import glob
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from mftlake.sources import decode as D

SCHEMA = "image string, record_no bigint, raw binary"


def reader(path: str):
    """``read(address, length)`` over a file that the process sees; what lies beyond its end is cut off."""

    def read(address: int, length: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(address)
            return f.read(length)

    return read


def open_volumes(path: str) -> list[D.Volume]:
    """The volumes whose images a path or glob names, by name; in the driver."""
    return [D.volume(p, reader(p)) for p in sorted(glob.glob(path))]


@dataclass
class Records(InputPartition):
    image: str
    record_size: int
    #: (first record, records, byte address)
    pieces: list[tuple[int, int, int]]


class NtfsReader(DataSourceReader):
    """One partition per ``recordsPerPartition`` records (65,536 by default) of every readable volume."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("recordsperpartition", options.get("recordsPerPartition", 65_536)))
        self.least, self.most, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ``record_no``; all filters go back to Spark too, which applies them exactly."""
        for f in filters:
            if getattr(f, "attribute", None) == ("record_no",):
                if isinstance(f, EqualTo):
                    self._narrow({f.value})
                elif isinstance(f, In):
                    self._narrow(set(f.value))
                elif isinstance(f, GreaterThanOrEqual):
                    self.least = max(self.least, f.value)
                elif isinstance(f, GreaterThan):
                    self.least = max(self.least, f.value + 1)
                elif isinstance(f, LessThanOrEqual):
                    self.most = f.value if self.most is None else min(self.most, f.value)
                elif isinstance(f, LessThan):
                    self.most = f.value - 1 if self.most is None else min(self.most, f.value - 1)
            yield f

    def _narrow(self, wanted: set) -> None:
        wanted = {x for x in wanted if x is not None}
        self.only = wanted if self.only is None else self.only & wanted

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for v in open_volumes(self.path):
            if v.status not in ("ok", "partial_mft"):
                continue
            end = v.records if self.most is None else min(v.records, self.most + 1)
            if self.only is not None:
                ranges = [(r, r + 1) for r in sorted(self.only) if self.least <= r < end]
            else:
                ranges = [(a, min(a + self.step, end)) for a in range(self.least - self.least % self.step, end, self.step)]
                ranges = [(max(a, self.least), b) for a, b in ranges]
            for a, b in ranges:
                pieces = []
                for first, n, address in v.extents:
                    lo, hi = max(a, first), min(b, first + n)
                    if lo < hi:
                        pieces.append((lo, hi - lo, address + (lo - first) * v.geometry.record_size))
                if pieces:
                    out.append(Records(v.image, v.geometry.record_size, pieces))
        return out or [Records("", 0, [])]

    def read(self, partition: Records) -> Iterator[tuple]:
        if not partition.pieces:
            return
        size = partition.record_size
        at_once = max(1, (1 << 20) // size)
        with open(partition.image, "rb") as f:
            for first, n, address in partition.pieces:
                f.seek(address)
                for i in range(0, n, at_once):
                    block = f.read(min(at_once, n - i) * size)
                    for j in range(min(at_once, n - i)):
                        yield partition.image, first + i + j, block[j * size : (j + 1) * size]


class NtfsSource(DataSource):
    """Options: ``path`` (a file or glob that driver and executors see), ``recordsPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "ntfs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NtfsReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets Spark push filters to it."""
    spark.dataSource.register(NtfsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
