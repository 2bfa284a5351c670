"""Problem 1: the N best rows of every group, by simultaneous bisection of all groups.

A row's code is order-preserving: the 64 bits of its score, made to compare like the number, then its identifier,
reversed, so that of equal scores the smaller identifier counts as better. Every open group has an interval of codes
that holds its N-th best row. A pass cuts all intervals at once at equally spaced midpoints, counts the rows above each
midpoint, keeps the part that holds the N-th row and shrinks it to the least and greatest code really present. Rows
below the interval go at once; a group closes when exactly N rows are left. The first pass takes the same midpoints for
all groups (the leading bits of the score), so it needs no join: it is one aggregation with partial sums before the
shuffle. Later passes read only rows of groups still open.

No task ever holds or sorts a whole group: ranks are given to the N chosen rows only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.skew import hot_keys, join_small_per_key
from quern.session import Scratch

#: Midpoints per pass and group. 64 settle six bits of the code at a time.
FANOUT = 64
#: The first pass tells scores apart by their leading 64 - COARSE_SHIFT bits: sign, exponent and six bits more.
COARSE_SHIFT = 46
#: The code is 128 bits wide, so at six bits a pass no group stays open longer.
MOST_PASSES = 40


def score_code(score: Column) -> Column:
    """An integer that orders like the double: its bits, with the rest flipped below zero. -0.0 counts as 0.0."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score.cast("double") + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a - F.pmod(a, b), b)


def _choose(buckets: DataFrame) -> DataFrame:
    """Of each group the bucket with the N-th row. buckets: g, phase, tie, need, bucket, cnt, lo, hi, id_lo, id_hi."""
    above = Window.partitionBy("g").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy("g")
    at = buckets.withColumns({"upto": F.sum("cnt").over(above), "all": F.sum("cnt").over(total)})
    need, upto = F.least("need", "all"), F.col("upto")
    hit = at.where((upto >= need) & (upto - F.col("cnt") < need))
    left = F.least("need", "all") - (F.col("upto") - F.col("cnt"))
    done = (F.col("cnt") == left) | ((F.col("phase") == 1) & (F.col("lo") == F.col("hi")))
    to_ids = ~done & (F.col("phase") == 0) & (F.col("lo") == F.col("hi"))
    return hit.select(
        "g",
        done.alias("done"),
        F.when(to_ids, 1).otherwise(F.col("phase")).alias("phase"),
        F.when(to_ids, F.col("lo")).otherwise(F.col("tie")).alias("tie"),
        F.when(to_ids, F.col("id_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(to_ids, F.col("id_hi")).otherwise(F.col("hi")).alias("hi"),
        left.alias("need"),
    )


_STATE = ["done", "phase", "tie", "lo", "hi", "need"]


def _kept() -> Column:
    """Rows at or above the lower end of their group's interval."""
    by_id = (F.col("score") > F.col("tie")) | ((F.col("score") == F.col("tie")) & (F.col("rev") >= F.col("lo")))
    return F.when(F.col("phase") == 0, F.col("score") >= F.col("lo")).otherwise(by_id)


def top_n_per_group(df: DataFrame, group: str, score: str, ident: str, n: int, fanout: int = FANOUT) -> DataFrame:
    """group, ident, rank_no (1 to n): the n rows of highest score of every group; of equal scores the smaller ident first.

    Rows with a null group, score or ident, or a NaN score, take no part. Groups with fewer rows give all of them. Rows
    that repeat a whole (group, score, ident) count each time. Infinite scores are ordinary scores. An empty table gives
    an empty result. ident is an integer column; other columns of df, whatever their names, aren't read.
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = df.sparkSession
    value = F.col(f"`{score}`").cast("double")
    named = df.select(F.col(f"`{group}`").alias("g"), value.alias("s"), F.col(f"`{ident}`").cast("bigint").alias("id"))
    rows = named.where(F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s") & F.col("id").isNotNull())
    rows = rows.select("g", score_code(F.col("s")).alias("score"), F.bitwise_not("id").alias("rev"))

    scratch = Scratch(spark, "topn")
    first = rows.groupBy("g", F.shiftright("score", COARSE_SHIFT).alias("bucket")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("rev").alias("id_lo"), F.max("rev").alias("id_hi")
    )
    first = scratch.write(first, "first")
    sizes = first.groupBy("g").agg(F.sum("cnt").alias("size"))
    hot = hot_keys(sizes, "g", "size", total=first.agg(F.sum("cnt")).first()[0] or 0)
    state = _choose(first.withColumns({"phase": F.lit(0), "tie": F.lit(0).cast("bigint"), "need": F.lit(n).cast("bigint")}))

    names, current = [], rows
    for step in range(MOST_PASSES):
        kept = join_small_per_key(current.select("g", "score", "rev"), state, "g", hot).where(_kept())
        names.append(f"pass{step}")
        table = scratch.write(kept, names[-1], partition_by=("done",))
        current = table.where(~F.col("done"))
        if not current.take(1):
            break
        code = F.when(F.col("phase") == 0, F.col("score")).when(F.col("score") == F.col("tie"), F.col("rev"))
        width = _floor_div(F.col("hi"), F.lit(fanout)) - _floor_div(F.col("lo"), F.lit(fanout)) + 1
        inside = current.withColumn("code", code).where(F.col("code").between(F.col("lo"), F.col("hi"))).withColumn("bucket", _floor_div(F.col("code"), width))
        counted = inside.groupBy("g", "bucket").agg(
            F.count(F.lit(1)).alias("cnt"), F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("rev").alias("id_lo"), F.max("rev").alias("id_hi"),
            F.first("phase").alias("phase"), F.first("tie").alias("tie"), F.first("need").alias("need"),
        )
        state = scratch.write(_choose(counted), f"state{step}")
    else:
        raise RuntimeError("the code is wider than the passes settle")

    like = T.StructType([f for f in table.schema.fields])
    closed = [spark.read.schema(like).parquet(f"{scratch.path}/{x}").where("done").select("g", "score", "rev") for x in names]
    chosen = reduce(DataFrame.unionByName, closed).groupBy("g", "score", "rev").agg(F.count(F.lit(1)).alias("times"))
    each = chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(n)).cast("int"))))
    order = Window.partitionBy("g").orderBy(F.col("score").desc(), F.col("rev").desc(), "copy")
    ranked = each.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= n)
    return ranked.select(F.col("g").alias(group), F.bitwise_not("rev").alias(ident), "rank_no")
