"""New Java files of a folder, parsed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.java import parse_all


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, text)`` of every new ``*.java`` file, as a stream."""
    files = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.java").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stream_graphs(spark: SparkSession, folder: str, to: str, checkpoint: str) -> StreamingQuery:
    """Append the graph rows of new files to Parquet; each file once, also over restarts."""
    rows = parse_all(stream_sources(spark, folder))
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
