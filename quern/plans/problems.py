"""Queries of the problem that belongs to the core: mixed timestamp formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.timestamps import normalise_timestamps
from quern.session import shared_dir


def _instants(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Candidates with their instants; the dictionary of parsed dates is kept below the shared folder, for later runs."""
    candidates = spark.read.parquet(f"{folder}/candidates.parquet").select("ord", "source_id", "published", *columns)
    clocks = spark.read.parquet(f"{folder}/sources.parquet").select(F.col("id").alias("source_id"), "tz", "country")
    return normalise_timestamps(candidates.join(clocks, "source_id", "left"), "published", "tz", "country", dictionary=f"{shared_dir(spark)}/quern-kept/instants")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _instants(spark, folder).where("epoch_ms IS NOT NULL").select("ord", "epoch_ms")


def p4_readable(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, rows, readable: how many of each source's dates denote one instant."""
    return _instants(spark, folder).groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"), F.count("epoch_ms").alias("readable"))


QUERIES = {"p4_found": p4_found, "p4_readable": p4_readable}
