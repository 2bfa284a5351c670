"""Streams of items: first deliveries within a time to live, and counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the file, or the files of the folder, at path, with the schema of like."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(like.schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).parquet(folder)


def first_within(stream: DataFrame, key: str, time: str, ttl: str = "60 days") -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark is ttl past it, so the state stays bounded."""
    return stream.withWatermark(time, ttl).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, time: str, group: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, group, n, total: rows and sums of each window; rows later than late are dropped."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("start"), group, "n", "total")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet below folder, and returns the table."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
