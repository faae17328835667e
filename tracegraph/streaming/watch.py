"""Rebuild the graph whenever files land in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LANDED = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive below ``folder``; each is read once."""
    return spark.readStream.format("binaryFile").schema(LANDED).option("recursiveFileLookup", True).load(folder)


def watch(spark: SparkSession, folder: str, checkpoint: str, rebuild: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Call ``rebuild(batch, number)`` for each batch of landed files. The number repeats if a batch is run again, so a version that is
    published under it is published once."""
    writer = landing_stream(spark, folder).writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
