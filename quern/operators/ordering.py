"""Orders over whole tables without a single-task window: row numbers, batches, top rows with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import Scratch


def global_row_number(df: DataFrame, order: list[str], out: str = "row_no") -> DataFrame:
    """df with out: 1, 2, ... in ascending order of the columns.

    Rows are range-partitioned and numbered within their partition; the partitions' sizes, one row each, give the
    offsets. The order should have no ties, or equal rows are numbered arbitrarily.
    """
    scratch = Scratch(df.sparkSession, "row-number")
    part = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    part = scratch.write(part, "parts")
    sizes = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__own", number).join(offsets, "__part").withColumn(out, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of its key up to this one, in order. The order should have no ties.

    Rows are range-partitioned by key and order, so a key of most rows lies in many partitions: each sums up its own part of a
    key, and the parts before it, one row each, are added.
    """
    scratch = Scratch(df.sparkSession, "running-sum")
    part = df.withColumn("__v", value).repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    part = scratch.write(part, "parts")
    sums = part.groupBy(F.col(key).alias("__key"), "__part").agg(F.sum("__v").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition at most
    sums = sums.select("__key", "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    upto = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = part.withColumn("__own", F.sum("__v").over(upto)).withColumnRenamed("__part", "__at")
    joined = own.join(sums, (F.col("__at") == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn(out, F.col("__own") + F.col("__before")).drop("__v", "__part", "__at", "__key", "__sum", "__before", "__own")


def batches(df: DataFrame, order: list[str], size: int, out: str = "batch_no") -> DataFrame:
    """df with out: the number, from 0, of the batch of size rows that a row falls into."""
    return global_row_number(df, order, "__row").withColumn(out, F.floor((F.col("__row") - 1) / size)).drop("__row")


def top_or_all(df: DataFrame, wanted: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows among those wanted, or among all rows if none is wanted."""
    none = df.where(wanted).limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))  # one row
    return df.crossJoin(F.broadcast(none)).where(wanted | F.col("__none")).drop("__none").orderBy(*order).limit(n)


def first_in_group(df: DataFrame, group: list[str], order: list[Column], n: int, out: str = "rank_no") -> DataFrame:
    """The first n rows of every group; Spark drops further rows before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= n)


def related(df: DataFrame, group: str, ident: str, order: list[Column], n: int) -> DataFrame:
    """ident, others: of every row the identifiers of the first n other rows of its group, in order.

    Only the first n + 1 rows of each group are candidates, so the join adds at most that many rows to one.
    """
    best = first_in_group(df.where(F.col(group).isNotNull()), [group], order, n + 1)
    lists = best.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", ident))), lambda x: x[ident]).alias("__best"))
    others = F.slice(F.filter("__best", lambda x: x != F.col(ident)), 1, n)
    return df.join(lists, group).select(ident, others.alias("others"))
