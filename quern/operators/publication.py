"""Queries behind published pages: windows of time, lists, feeds, site maps, reservations, ranked sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import xml_escape
from quern.functions.url import address_parts, domain, domain_suffixes


def in_window(time: Column, now: Column, oldest_hours: int, youngest_hours: int = 0) -> Column:
    """Between oldest and youngest hours before now, both ends included."""
    ago = lambda h: now - F.make_interval(hours=F.lit(h))
    return time.between(ago(oldest_hours), ago(youngest_hours))


def of_listed_domain(df: DataFrame, url: str, domains: DataFrame, listed: str) -> DataFrame:
    """Rows whose host is a listed domain or below one: hosts' suffixes are joined by equality, no prefix is scanned."""
    hosts = df.select(F.col(url).alias("__u")).distinct().select("__u", F.explode(domain_suffixes(domain(F.col("__u")))).alias("__s"))
    hit = hosts.join(domains.select(F.lower(listed).alias("__s")).distinct(), "__s", "left_semi").select("__u").distinct()
    return df.join(hit, F.col(url) == F.col("__u"), "left_semi")


def reservation_note(headers: Column, meta: Column) -> Column:
    """Which marks reserve a page against mining, in order, joined by semicolons; empty if none does."""
    low = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    head, tags = low(F.coalesce(headers, F.create_map().cast("map<string,string>"))), low(F.coalesce(meta, F.create_map().cast("map<string,string>")))
    robots = F.lower(F.coalesce(F.try_element_at(tags, F.lit("robots")), F.lit("")))
    return F.array_join(F.array_compact(F.array(
        F.when(F.try_element_at(head, F.lit("tdm-reservation")) == "1", "tdm-reservation header"),
        F.when(F.try_element_at(tags, F.lit("tdm-reservation")) == "1", "tdm-reservation meta"),
        F.when(F.rlike(robots, F.lit(r"\bno(?:image)?ai\b")), "robots noai meta"),
    )), "; ")


def ranked_sources(df: DataFrame, group: str, name: str, role: str, order: str, most: int = 4) -> DataFrame:
    """group, name, role, rank_no: of each group the first sources by role and order, each name (case aside) once."""
    weight = F.when(F.col(role) == "primary", 0).when(F.col(role) == "corroborating", 1).when(F.col(role) == "lead", 2).otherwise(3)
    rows = df.where(F.col(name).isNotNull() & F.col(group).isNotNull()).select(group, name, role, order, weight.alias("__w"))
    once = rows.groupBy(group, F.lower(name).alias("__n")).agg(F.min(F.struct("__w", order, name, role)).alias("__r")).select(group, "__r.*")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("__w", order))
    return once.withColumn("rank_no", rank).where(F.col("rank_no") <= most).select(group, name, role, "rank_no")


def rss_item(title: Column, link: Column, description: Column, time: Column) -> Column:
    """An item element of RSS 2.0, with an RFC 2822 date in UTC."""
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), xml_escape(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    return F.concat(F.lit("<item>"), part("title", title), part("link", link), part("description", description), part("pubDate", F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss Z")), F.lit("</item>"))


def joined(df: DataFrame, entry: Column, order: list[Column], n: int, head: str, foot: str, out: str = "document") -> DataFrame:
    """One row: a document of the first n entries in order, between head and foot. At most n rows are brought together."""
    first = df.withColumn("__e", entry).orderBy(*order).limit(n).withColumn("__n", F.monotonically_increasing_id())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__n", "__e"))), lambda x: x["__e"])
    return first.agg(F.concat(F.lit(head), F.array_join(parts, ""), F.lit(foot)).alias(out))


def news_entry(url: Column, publication: Column, language: Column, time: Column, title: Column) -> Column:
    """An entry of a news site map."""
    tag = lambda name, c: F.concat(F.lit(f"<news:{name}>"), c, F.lit(f"</news:{name}>"))
    by = tag("publication", F.concat(tag("name", xml_escape(publication)), tag("language", language)))
    return F.concat(F.lit("<url><loc>"), xml_escape(url), F.lit("</loc>"), tag("news", F.concat(by, tag("publication_date", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")), tag("title", xml_escape(title)))), F.lit("</url>"))


def json_ld(kind: str, **fields: Column) -> Column:
    """A JSON-LD object of schema.org; fields that are null are left out."""
    return F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[c.alias(k) for k, c in fields.items()]))


def relative_links(html: Column, depth: Column) -> Column:
    """Links from the root as links from a page depth folders below it; folders become their index.html."""
    up = F.repeat(F.lit("../"), depth)
    link = r'(href|src|action)="/(?!/)'
    folder = F.regexp_replace(F.regexp_replace(html, link + r'([^"#?]*/)?(?=["#?])', '$1="/$2index.html'), link, '$1="\u0001')
    return F.replace(folder, F.lit("\u0001"), up)


def issue_text(df: DataFrame, key: str, title: str, problem: str) -> DataFrame:
    """key, text: a heading and the sorted distinct problems of every item as Markdown."""
    lines = F.transform(F.array_sort(F.collect_set(problem)), lambda p: F.concat(F.lit("- "), p))
    return df.where(F.col(problem).isNotNull()).groupBy(key).agg(F.concat(F.lit("### "), F.first(title), F.lit("\n"), F.array_join(lines, "\n")).alias("text"))


def reserved_by_rules(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """df with reserved: a rule (host, location, reserved) of the address's host covers its path; stars in locations are ignored.

    A host has few rules, so they are gathered per host and tested row by row.
    """
    prefix = F.replace(F.coalesce("location", F.lit("")), F.lit("*"), F.lit(""))
    per_host = rules.where(F.trim(F.col("reserved").cast("string")) == "1").groupBy(F.lower("host").alias("__h")).agg(F.collect_set(F.when(prefix == "", "/").otherwise(prefix)).alias("__p"))
    part = address_parts(F.col(url))
    rows = df.withColumn("__host", part["host"]).join(per_host, F.col("__host") == F.col("__h"), "left")
    covered = F.exists("__p", lambda p: F.startswith(part["path"], p))
    return rows.withColumn("reserved", F.coalesce(covered, F.lit(False))).drop("__host", "__h", "__p")


def robots_allow(robots: Column, agent: str, url: Column) -> Column:
    """Whether a robots.txt lets the agent fetch the address; a null or empty file allows all."""

    def allowed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from functools import lru_cache
        from urllib.robotparser import RobotFileParser

        @lru_cache(1024)
        def parsed(text: str) -> RobotFileParser:
            rules = RobotFileParser()
            rules.parse(text.splitlines())
            return rules

        for texts, urls in batches:
            yield pa.array([not t or u is None or parsed(t).can_fetch(agent, u) for t, u in zip(texts.to_pylist(), urls.to_pylist())], pa.bool_())

    allowed.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(allowed, T.BooleanType())(robots, url)


def also_moving(df: DataFrame, top: DataFrame, ident: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows that aren't among the top ones."""
    return df.join(top.select(ident), ident, "left_anti").orderBy(*order).limit(n)


def sitemap_entry(url: Column, changed: Column) -> Column:
    return F.concat(F.lit("<url><loc>"), xml_escape(url), F.lit("</loc><lastmod>"), F.date_format(changed, "yyyy-MM-dd"), F.lit("</lastmod></url>"))
