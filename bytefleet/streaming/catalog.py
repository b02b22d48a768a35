"""A catalogue that follows a drop folder: an extension, as the batch tools have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytefleet.functions.scalars import SIZE_CAP


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(path, modified, length, hash) of files as they arrive."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.filter(F.col("length") <= SIZE_CAP).select("path", F.col("modificationTime").alias("modified"), "length", F.upper(F.sha2("content", 256)).alias("hash"))


def first_seen(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each hash once within the watermark; state is bounded by the delay."""
    return rows.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["hash"])


def follow(rows: DataFrame, table_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to the Parquet catalogue, exactly once."""
    writer = rows.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
