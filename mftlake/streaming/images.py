"""Images as a stream: every new file in a folder is handed on once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mftlake.sources.relations import Image


def new_images(spark: SparkSession, folder: str, pattern: str = "*.img", at_once: int = 16) -> DataFrame:
    """A stream of ``path``, ``modified`` and ``length`` of image files as they appear; their bytes are not read."""
    kind = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.schema(kind).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder)
    return found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), "length")


def on_new_images(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[Image, int], None], at_once: int = 16, **trigger) -> StreamingQuery:
    """Calls ``handle(image, batch)`` for every new image; the checkpoint remembers which were handed on.

    A batch names ``at_once`` files at most, so the driver holds no more paths than that. ``trigger``: of the stream's
    writer, such as ``availableNow=True``.
    """

    def batch(df: DataFrame, number: int) -> None:
        for row in df.select("path").orderBy("path").collect():
            handle(Image(spark, row["path"]), number)

    writer = new_images(spark, folder, at_once=at_once).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
