"""Recovery: streams written out as files, on the executors."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mftlake import constants as C

CHUNKS = "image", "record_no", "attr", "slot", "name", "at", "bytes"
DATA_SLOT = C.TYPE["DATA"] // 16 - 1


def recover_table(chunks: DataFrame, path: str) -> None:
    """Chunks as Parquet, those of a record together and in order: what any job can take up again."""
    chunks.select(*CHUNKS).repartition("image", "record_no").sortWithinPartitions("image", "record_no", "slot", "name", "at").write.parquet(path)


def recover_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Every stream as a file ``record_no`` or ``record_no.name`` in ``folder`` (one that is no data has its type before the name), which driver and executors must share.

    A stream's chunks meet in one task, sorted by offset, and are written as they come. A file appears under its name
    once it is complete, so a task that is run again does no harm. Returns ``image``, ``record_no``, ``name``, ``path``, ``n_bytes``.
    """
    os.makedirs(folder, exist_ok=True)
    dealt = chunks.select(*CHUNKS).repartition("image", "record_no", "slot", "name").sortWithinPartitions("image", "record_no", "slot", "name", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, file, size, target = None, None, 0, ""

        def finish() -> list[dict]:
            if file is None:
                return []
            file.close()
            os.replace(file.name, target)
            return [{"image": key[0], "record_no": key[1], "name": key[3], "path": target, "n_bytes": size}]

        kinds = pa.schema([("image", pa.string()), ("record_no", pa.int64()), ("name", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64())])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                here = (r["image"], r["record_no"], r["slot"], r["name"])
                if here != key:
                    done += finish()
                    kind = "" if r["slot"] == DATA_SLOT else f".{C.ATTRIBUTES[r['slot']]}"
                    label = f"{r['record_no']}{kind}" + (f".{r['name']}".replace("/", "_") if r["name"] else "")
                    key, size, target = here, 0, os.path.join(folder, f"{os.path.basename(r['image'])}-{label}")
                    file = open(f"{target}.{os.getpid()}.part", "wb")  # noqa: SIM115
                file.seek(r["at"])
                file.write(r["bytes"])
                size = max(size, r["at"] + len(r["bytes"]))
            if done:
                yield pa.RecordBatch.from_pylist(done, kinds)
        last = finish()
        if last:
            yield pa.RecordBatch.from_pylist(last, kinds)

    return dealt.mapInArrow(run, "image string, record_no bigint, name string, path string, n_bytes bigint")


def large(chunks: DataFrame, over: int = 100 << 20) -> DataFrame:
    """Streams above a size, which a caller may want to ask about before it recovers them."""
    return chunks.groupBy("image", "record_no", "slot", "name").agg(F.max(F.col("at") + F.octet_length("bytes")).alias("n_bytes")).filter(F.col("n_bytes") > over)
