"""Re-checking of what was published: marks that are due, pages that changed, the health of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.evidence import verbatim

MARKS = (6, 24, 168, 720)


def due_mark(published: Column, checked: Column, now: Column, marks: tuple[int, ...] = MARKS) -> Column:
    """The latest mark (hours after publication) that has passed and wasn't checked since; null if none is due."""
    at = lambda h: published + F.make_interval(hours=h.cast("int"))
    passed = F.filter(F.array(*[F.lit(h) for h in marks]), lambda h: at(h) <= now)
    latest = F.array_max(passed)
    return F.when(latest.isNotNull() & (checked.isNull() | (checked < at(latest))), latest)


def recheck(claims: DataFrame, pages: DataFrame, key: str, claim: str, span: str) -> DataFrame:
    """claim, problem: gone (404, 410), unreachable, or passage changed; null if the span still stands on the page."""
    joined = claims.join(pages.select(key, "status", "text"), key, "left")
    gone = F.col("status").isin(404, 410)
    unread = F.col("status").isNull() | (F.col("status") != 200) | (F.coalesce(F.col("text"), F.lit("")) == "")
    changed = ~F.coalesce(verbatim(F.col(span), F.col("text")), F.lit(False))
    problem = F.when(gone, "source is gone").when(unread, "source can't be read").when(changed, F.concat(F.lit("passage no longer found: "), F.substring(F.col(span), 1, 90)))
    return joined.select(claim, problem.alias("problem"))


def feed_health(items: DataFrame, sources: DataFrame, source: str, ident: str) -> DataFrame:
    """source, items, titled, ok of every registered source; ok if it delivered any titled item."""
    got = items.groupBy(F.col(source).alias("__s")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.coalesce(F.length("title"), F.lit(0)) > 0).alias("titled"))
    rows = sources.select(F.col(ident).alias(source)).join(got, F.col(source) == F.col("__s"), "left").drop("__s")
    return rows.na.fill(0, ["items", "titled"]).withColumn("ok", F.col("titled") > 0)
