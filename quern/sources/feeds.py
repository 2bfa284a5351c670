"""Feeds as tables of candidates: RSS and Atom files, JSON lists of articles, and their union with source defaults."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import strip_tags

ITEM = "title STRING, link STRING, description STRING, pubDate STRING"
ENTRY = "title STRING, link STRUCT<_href: STRING>, summary STRING, updated STRING, published STRING"
ARTICLE = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, language: STRING>>"
#: Summaries are cut to this length as items are read.
SUMMARY = 1200


def _candidate(source: Column, url: Column, title: Column, summary: Column, published: Column) -> list[Column]:
    """Columns of a candidate; summaries are text without markup."""
    return [source.alias("source_id"), F.trim(url).alias("url"), strip_tags(title).alias("title"), F.substring(strip_tags(F.coalesce(summary, F.lit(""))), 1, SUMMARY).alias("summary"), published.alias("published")]


def read_rss(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Items of RSS 2.0 files; items without a link are left out, unreadable ones are skipped."""
    rows = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(ITEM).load(path)
    return rows.select(*_candidate(F.lit(source_id), F.col("link"), F.col("title"), F.col("description"), F.col("pubDate"))).where(F.length("url") > 0)


def read_atom(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Entries of Atom files."""
    rows = spark.read.format("xml").option("rowTag", "entry").option("mode", "DROPMALFORMED").schema(ENTRY).load(path)
    return rows.select(*_candidate(F.lit(source_id), F.col("link._href"), F.col("title"), F.col("summary"), F.coalesce("published", "updated"))).where(F.length("url") > 0)


def read_articles(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Articles of JSON answers; files that can't be read give no rows."""
    rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(ARTICLE).json(path).select(F.explode("articles").alias("a"))
    return rows.select(*_candidate(F.lit(source_id), F.col("a.url"), F.col("a.title"), F.lit(""), F.col("a.seendate"))).where(F.length("url") > 0)


def read_all(readers: dict[str, Callable[[], DataFrame]], sources: DataFrame, only: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """All feeds together, and the errors of those that failed: a feed that can't be read doesn't stop the others.

    readers: per source id a function that reads its feed. Restricted sources, and those not in only, aren't read at all.
    """
    barred = {r[0] for r in sources.where(F.col("rights") == "RESTRICTED").select("id").collect()}  # the register, a row per feed
    parts, errors = [], {}
    for name, read in readers.items():
        if name in barred or (only is not None and name not in only):
            continue
        try:
            part = read()
            part.limit(1).collect()
            parts.append(part)
        except Exception as wrong:  # noqa: BLE001 - whatever a feed's reader raises
            errors[name] = str(wrong).splitlines()[0]
    return (union_feeds(parts) if parts else None), errors


def with_source_defaults(items: DataFrame, sources: DataFrame) -> DataFrame:
    """items with tier, rights, name and sections of their source: tier 4, LINK_ONLY, the id and no sections where it has none.
    Items of restricted sources are left out."""
    known = sources.select(F.col("id").alias("source_id"), "tier", "rights", F.col("name").alias("source_name"), F.col("sections").alias("sections_hint"), "owner_org")
    rows = items.join(known, "source_id", "left").where(~F.col("rights").eqNullSafe("RESTRICTED"))
    return rows.withColumns({
        "tier": F.coalesce("tier", F.lit(4)), "rights": F.coalesce("rights", F.lit("LINK_ONLY")), "source_name": F.coalesce("source_name", "source_id"),
        "sections_hint": F.coalesce("sections_hint", F.array().cast("array<string>")),
    })


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """All feeds together; a feed that lacks a column has nulls in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
