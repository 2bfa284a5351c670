"""The engine's own queries over the test tables, each with SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import display, text as X
from quern.functions.html import page_extract
from quern.functions.url import domain, feed_address
from quern.operators import audit, checks, discovery, evidence, gathering, monitoring, ordering, publication, series
from quern.session import Scratch, spread
from quern.sources import files
from quern.streaming import feeds as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Pieces of SQL that several queries share.
_SP = "[ \\t\\n\\r\\f\\x0B\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}\\x{0085}\\x{1680}\\x{2028}\\x{2029}]"
_NORM = "trim(regexp_replace(translate({0}, '‘’“”–— ', '''''\"\"-- '), '" + _SP + "+', ' ', 'g'), ' ')"
_ADDRESS = """(SELECT *, CASE WHEN q <> '' THEN b || '?' || q ELSE b END AS address FROM (
    SELECT *, sch || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS b,
        array_to_string(list_transform(list_filter(string_split(regexp_extract(body, '\\?(.*)$', 1), '&'),
            lambda x: regexp_matches(x, '^[^=]*=.') AND NOT regexp_matches(url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), '^(?:utm_|fbclid|gclid|mc_|ref$|ref_src|cmpid|ito)')),
            lambda x: replace(url_encode(url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))), '%20', '+')), '&') AS q
    FROM (SELECT *, lower(regexp_extract(body, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_replace(regexp_extract(body, '^[^/?]*([^?]*)', 1), ';[^/]*$', ''), '/+$', '') AS path
    FROM (SELECT *, lower(coalesce(nullif(regexp_extract(trim(url, ' '), '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1), ''), 'https')) AS sch,
        regexp_replace(regexp_replace(trim(url, ' '), '#(?s:.)*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', '') AS body FROM {0} WHERE url IS NOT NULL))))"""


@query(f"SELECT doc_id, length(n) AS chars, sha256(n) AS digest FROM (SELECT doc_id, {_NORM.replace('{0}', 'text')} AS n FROM documents WHERE text IS NOT NULL)")
def normalised_documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.norm_space(F.col("text")).alias("n"))
    return rows.select("doc_id", F.length("n").alias("chars"), F.sha2("n", 256).alias("digest"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN (" + _STOP + ")))"


@query(f"SELECT ord, array_to_string(list_sort({_WORDS.format('title')}), ' ') AS words FROM candidates WHERE title IS NOT NULL")
def title_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").where("title IS NOT NULL").select("ord", F.array_join(F.array_sort(X.topic_words(F.col("title"))), " ").alias("words"))


@query(f"SELECT ord, address, substr(sha256(address), 1, 16) AS key FROM {_ADDRESS.format('candidates')}")
def feed_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("url IS NOT NULL")
    return rows.select("ord", feed_address(F.col("url")).alias("address"), discovery.address_key(F.col("url")).alias("key"))


@query(f"""SELECT key, min(ord) AS ord FROM (SELECT ord, substr(sha256(address), 1, 16) AS key FROM {_ADDRESS.format('candidates')} WHERE title IS NOT NULL AND title <> '')
    WHERE key NOT IN (SELECT lower(url_key) FROM seen WHERE url_key IS NOT NULL) GROUP BY key""")
def unseen_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("url IS NOT NULL AND length(title) > 0").select("ord", discovery.address_key(F.col("url")).alias("key"))
    return discovery.unseen(rows, table(spark, folder, "seen").select(F.lower("url_key").alias("key")))


@query("""SELECT url_key, first_seen FROM seen WHERE try_cast(first_seen AS TIMESTAMPTZ) >= TIMESTAMPTZ '2026-01-12 00:00:00+00' - INTERVAL 5 DAY""")
def fresh_history(spark: SparkSession, folder: str) -> DataFrame:
    now = F.lit("2026-01-12T00:00:00+00:00").cast("timestamp")
    return discovery.fresh_seen(table(spark, folder, "seen"), now, days=5).select("url_key", "first_seen")


@query(f"""WITH RECURSIVE t AS (SELECT ord, {_WORDS.format('title')} AS w FROM candidates WHERE length(title) > 0),
    u AS (SELECT ord, len(w) AS n, unnest(w) AS x FROM t),
    c AS (SELECT a.ord AS a, b.ord AS b, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.x = b.x AND a.ord < b.ord GROUP BY 1, 2),
    p AS (SELECT b AS ord, min(a) AS parent FROM c WHERE k >= 0.6 * (n + m - k) GROUP BY 1),
    r AS (SELECT ord, ord AS cluster FROM t WHERE ord NOT IN (SELECT ord FROM p) UNION ALL SELECT p.ord, r.cluster FROM p JOIN r ON p.parent = r.ord)
    SELECT ord, cluster FROM r""")
def title_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return discovery.title_clusters(table(spark, folder, "candidates"))


@query("""SELECT cluster, ord, priority FROM (SELECT cluster, ord, priority, row_number() OVER (PARTITION BY cluster ORDER BY priority DESC, ord) AS r
    FROM candidates WHERE cluster IS NOT NULL AND priority IS NOT NULL AND NOT isnan(priority)) WHERE r = 1""")
def cluster_picks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("cluster IS NOT NULL AND priority IS NOT NULL AND NOT isnan(priority)")
    best = F.max_by(F.struct("ord", "priority"), F.struct(F.col("priority"), -F.col("ord"))).alias("x")
    return rows.groupBy("cluster").agg(best).select("cluster", "x.*")


@query("SELECT ord, priority FROM candidates WHERE priority IS NOT NULL AND NOT isnan(priority) ORDER BY priority DESC, ord LIMIT 60")
def shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the 60 candidates of highest priority."""
    return table(spark, folder, "candidates").where("priority IS NOT NULL AND NOT isnan(priority)").select("ord", "priority").orderBy(F.desc("priority"), "ord").limit(60)


def _facts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Summaries as claims and documents as their sources, both with the key of their page."""
    claims = table(spark, folder, "candidates").where("url IS NOT NULL AND length(summary) > 0").select("ord", "summary", feed_address(F.col("url")).alias("page"))
    docs = table(spark, folder, "documents").where("url IS NOT NULL").select("doc_id", "text", "rights", feed_address(F.col("url")).alias("page"))
    return claims, docs


_CLAIMS = f"(SELECT ord, summary, address AS page FROM {_ADDRESS.format('candidates')} WHERE length(summary) > 0)"
_DOCS = f"(SELECT doc_id, text, rights, address AS page FROM {_ADDRESS.format('documents')})"


@query(f"""WITH d AS {_DOCS}, r AS (SELECT page, string_agg(text, ' ' ORDER BY doc_id) AS readable FROM d WHERE rights IN ('LICENSED', 'PRIMARY_PUBLIC') AND text IS NOT NULL GROUP BY page)
    SELECT c.ord, d.doc_id, CASE WHEN NOT coalesce(contains(lower({_NORM.replace('{0}', 'd.text')}), lower({_NORM.replace('{0}', 'c.summary')})), false) THEN 'supporting passage not found verbatim'
        WHEN d.rights = 'FACTS_ONLY' AND NOT coalesce(contains(lower({_NORM.replace('{0}', 'r.readable')}), lower({_NORM.replace('{0}', 'c.summary')})), false) THEN 'only in another outlet''s report; no primary confirmation' END AS why
    FROM {_CLAIMS} c LEFT JOIN d ON c.page = d.page LEFT JOIN r ON c.page = r.page""")
def claim_verification(spark: SparkSession, folder: str) -> DataFrame:
    claims, docs = _facts(spark, folder)
    return evidence.verify_claims(claims, docs, "page", "ord", "summary", "doc_id")


@query("""SELECT cluster, count(DISTINCT coalesce(nullif(owner_org, ''), source_name)) AS owners,
    CASE WHEN coalesce(bool_or(tier = 1 AND rights IN ('LICENSED', 'PRIMARY_PUBLIC')), false) THEN 'primary_confirmed' WHEN count(DISTINCT coalesce(nullif(owner_org, ''), source_name)) >= 2 THEN 'two_independent' ELSE 'single_source' END AS class
    FROM candidates WHERE cluster IS NOT NULL GROUP BY cluster""")
def corroboration(spark: SparkSession, folder: str) -> DataFrame:
    owner = F.coalesce(F.nullif(F.col("owner_org"), F.lit("")), F.col("source_name"))
    return evidence.corroboration(table(spark, folder, "candidates"), "cluster", owner, F.col("tier"), F.col("rights"))


@query("""SELECT doc_id, CASE WHEN rights IN ('LICENSED', 'PRIMARY_PUBLIC') AND tier <= 2 THEN 'primary' ELSE 'lead' END AS fetched_as,
    CASE WHEN rights IN ('LICENSED', 'PRIMARY_PUBLIC') THEN length(text) WHEN rights = 'FACTS_ONLY' THEN 12 END AS visible_chars FROM documents""")
def document_roles(spark: SparkSession, folder: str) -> DataFrame:
    shown = evidence.visible_text(F.col("text"), F.col("rights"))
    return table(spark, folder, "documents").select("doc_id", evidence.source_role(F.col("rights"), F.col("tier")).alias("fetched_as"), F.length(shown).alias("visible_chars"))


_RUN = "(SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - {1} + 2), lambda i: array_to_string(w[i:i + {1} - 1], ' ')))) AS run FROM (SELECT {2} AS id, regexp_extract_all(lower({3}), '[a-z0-9'']+') AS w FROM {0}) WHERE len(w) >= {1})"


def _copied(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return evidence.copied_runs(table(spark, folder, "candidates"), table(spark, folder, "documents"), "ord", "summary", "text", n)


@query(f"SELECT m.id AS ord, count(*) AS runs, count(t.run) AS copied FROM {_RUN.format('candidates', 12, 'ord', 'summary')} m LEFT JOIN (SELECT DISTINCT run FROM {_RUN.format('documents', 12, 'doc_id', 'text')}) t ON m.run = t.run GROUP BY 1")
def copied_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _copied(spark, folder, 12)


@query(f"SELECT m.id AS ord, count(*) AS runs, count(t.run) AS copied FROM {_RUN.format('candidates', 5, 'ord', 'summary')} m LEFT JOIN (SELECT DISTINCT run FROM {_RUN.format('documents', 5, 'doc_id', 'text')}) t ON m.run = t.run GROUP BY 1 HAVING count(t.run) * 100 > count(*) * 15")
def copied_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return _copied(spark, folder, 5).where("copied * 100 > runs * 15")


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries as drafts, with the texts of their page's documents as evidence, in order."""
    claims, docs = _facts(spark, folder)
    texts = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("t"))))
    by_page = docs.groupBy("page").agg(F.transform(texts, lambda x: x["t"]).alias("sources"))
    return claims.join(by_page, "page").withColumn("evidence", F.array_join("sources", " "))


@query()
def draft_checks(spark: SparkSession, folder: str) -> DataFrame:
    names = ["numbers", "dates", "quotes", "entities", "hype", "copying"]
    return checks.long_form(checks.run_all(_drafts(spark, folder), "summary", "evidence", "sources"), "ord", names)


@query()
def draft_check_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return draft_checks(spark, folder).groupBy("check").pivot("status", ["pass", "warn", "fail"]).agg(F.count(F.lit(1))).na.fill(0)


_YEARS = "list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace({0}, '([^0-9A-Za-z_])', '\\1 ', 'g') || ' ', '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9][0-9])(?:[^0-9A-Za-z_])', 1), lambda x: x))"


@query(f"SELECT doc_id, array_to_string(list_sort({_YEARS.format('text')}), ' ') AS years FROM documents WHERE text IS NOT NULL")
def document_years(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.array_sort(X.years(F.col("text"))), " ").alias("years"))


_RELATIVE = X.RELATIVE_DATES


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{_RELATIVE}', 1))), ', ') AS words FROM documents WHERE text IS NOT NULL")
def relative_dates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(X.relative_dates(F.col("text")), ", ").alias("words"))


_HYPE = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(?:^|[^0-9a-z_-]){w.replace(chr(39), chr(39) * 2)}(?:[^0-9a-z_-]|$)') THEN '{w.replace(chr(39), chr(39) * 2)}' END" for w in X.HYPE_WORDS)


@query(f"SELECT doc_id, array_to_string(list_filter([{_HYPE}], lambda x: x IS NOT NULL), ', ') AS words FROM documents WHERE text IS NOT NULL")
def strong_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(X.words_used(F.col("text"), X.HYPE_WORDS), ", ").alias("words"))


@query("""SELECT doc_id, len(q) AS quotations, array_to_string(q, ' | ') AS passages FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '["“]([^"”]{12,}?)["”]', 1),
    lambda x: regexp_replace(x, '^[ .,]+|[ .,]+$', '', 'g')), lambda x: len(regexp_split_to_array(trim(x, ' '), '[ \\t\\n\\x0B\\f\\r]+')) >= 3) AS q FROM documents WHERE text IS NOT NULL)""")
def document_quotations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.quotations(F.col("text")).alias("q"))
    return rows.select("doc_id", F.size("q").alias("quotations"), F.array_join("q", " | ").alias("passages"))


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN n < 120 THEN 'article under 120 words' END, CASE WHEN n > 900 THEN 'article over 900 words' END,
    CASE WHEN coalesce(trim(title, ' '), '') = '' THEN 'missing title' END, CASE WHEN NOT coalesce(rights IN ('LICENSED', 'PRIMARY_PUBLIC') AND tier <= 2, false) THEN 'no primary source' END], lambda x: x IS NOT NULL), '; ') AS problems
    FROM (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda w: w <> '')) AS n FROM documents)""")
def document_structure(spark: SparkSession, folder: str) -> DataFrame:
    primary = F.col("rights").isin(*evidence.READABLE) & (F.col("tier") <= 2)
    return table(spark, folder, "documents").select("doc_id", F.array_join(checks.structure(F.col("text"), F.col("title"), primary)["details"], "; ").alias("problems"))


_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def _stories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.col("ts"), "user_id", "event_type", "value", "props")


def _now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


@query(f"SELECT event_id, value FROM events WHERE ts BETWEEN {_NOW} - INTERVAL 26 HOUR AND {_NOW} - INTERVAL 6 HOUR ORDER BY value DESC, ts DESC, event_id LIMIT 7")
def newsletter_pick(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the seven strongest stories between 26 and 6 hours old."""
    rows = _stories(spark, folder).where(publication.in_window(F.col("ts"), _now(), 26, 6))
    return rows.orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(7).select("event_id", "value")


@query(f"""WITH r AS (SELECT *, ts >= {_NOW} + INTERVAL 900 DAY AS recent FROM events)
    SELECT event_id, value FROM r WHERE recent OR NOT (SELECT coalesce(bool_or(recent), false) FROM r) ORDER BY value DESC, ts DESC, event_id LIMIT 3""")
def top_recent_or_all(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report that falls back to all rows where none is recent."""
    late = F.col("ts") >= _now() + F.make_interval(days=F.lit(900))
    return ordering.top_or_all(_stories(spark, folder), late, [F.desc("value"), F.desc("ts"), F.col("event_id")], 3).select("event_id", "value")


@query("""SELECT event_type, event_id, CAST(r AS INTEGER) AS rank_no FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 4""")
def section_fronts(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.first_in_group(_stories(spark, folder), ["event_type"], [F.desc("ts"), F.col("event_id")], 4).select("event_type", "event_id", "rank_no")


@query("""WITH b AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events),
    l AS (SELECT event_type, list(event_id ORDER BY r) AS best FROM b WHERE r <= 4 GROUP BY 1)
    SELECT e.event_id, array_to_string(list_filter(l.best, lambda x: x <> e.event_id)[1:3], ' ') AS others FROM events e JOIN l USING (event_type)""")
def related_stories(spark: SparkSession, folder: str) -> DataFrame:
    rows = ordering.related(_stories(spark, folder), "event_type", "event_id", [F.desc("ts"), F.col("event_id")], 3)
    return rows.select("event_id", F.array_join(F.transform("others", lambda x: x.cast("string")), " ").alias("others"))


@query("""SELECT day, count(*) AS stories, count(DISTINCT user_id) AS publishers, sum(CAST(round(value * 100) AS BIGINT)) AS cents,
    count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) WHERE day = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY day""")
def newest_day_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stories(spark, folder).withColumn("day", F.to_date("ts"))
    newest = rows.agg(F.max("day").alias("day"))  # one row
    return rows.join(F.broadcast(newest), "day").groupBy("day").agg(
        F.count(F.lit(1)).alias("stories"), F.count_distinct("user_id").alias("publishers"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@query("""SELECT o_orderkey, CAST(l_linenumber AS INTEGER) AS line, l_returnflag AS flag, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS INTEGER) AS place
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def nested_lines_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    """Lines are gathered into their order's array, newest first, and taken apart again with their places."""
    newest = (-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("newest")
    line = F.struct(newest, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    nested = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")
    each = nested.select("o_orderkey", F.posexplode("lines").alias("i", "x"))
    return each.select("o_orderkey", F.col("x.l_linenumber").cast("int").alias("line"), F.col("x.l_returnflag").alias("flag"), (F.col("i") + 1).alias("place"))


@query(f"""SELECT event_id, CAST(list_max(list_filter([6, 24, 168, 720], lambda h: ts + to_hours(h) <= {_NOW})) AS INTEGER) AS mark FROM events
    WHERE list_max(list_filter([6, 24, 168, 720], lambda h: ts + to_hours(h) <= {_NOW})) IS NOT NULL""")
def due_checks(spark: SparkSession, folder: str) -> DataFrame:
    due = monitoring.due_mark(F.col("ts"), F.lit(None).cast("timestamp_ntz"), _now())
    return _stories(spark, folder).select("event_id", due.alias("mark")).where("mark IS NOT NULL")


@query(f"""SELECT c.ord, CASE WHEN p.status IN (404, 410) THEN 'source is gone' WHEN p.status IS NULL OR p.status <> 200 OR coalesce(p.text, '') = '' THEN 'source can''t be read'
    WHEN NOT coalesce(contains(lower({_NORM.replace('{0}', 'p.text')}), lower({_NORM.replace('{0}', 'c.summary')})), false) THEN 'passage no longer found: ' || substr(c.summary, 1, 90) END AS problem
    FROM {_CLAIMS} c LEFT JOIN (SELECT address AS page, status, text FROM {_ADDRESS.format('pages')}) p ON c.page = p.page""")
def source_rechecks(spark: SparkSession, folder: str) -> DataFrame:
    claims, _ = _facts(spark, folder)
    pages = table(spark, folder, "pages").where("url IS NOT NULL").select(feed_address(F.col("url")).alias("page"), "status", "text")
    return monitoring.recheck(claims, pages, "page", "ord", "summary")


_SERIES = "(SELECT o_orderpriority, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY 1, 2)"


@query(f"SELECT o_orderpriority, count(*) AS points, arg_min(v, y) AS first, arg_max(v, y) AS last, min(v) AS least, max(v) AS greatest, CASE WHEN arg_max(v, y) >= arg_min(v, y) THEN 'rose' ELSE 'fell' END AS trend FROM {_SERIES} GROUP BY 1")
def yearly_trackers(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.yearly_series(table(spark, folder, "orders"), "o_orderpriority", F.year("o_orderdate"), F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return rows.select("o_orderpriority", F.size("series").alias("points"), series.series_facts(F.col("series")).alias("x")).select("o_orderpriority", F.col("points").cast("bigint"), "x.*")


@query()
def tracker_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.yearly_series(table(spark, folder, "orders"), "o_orderpriority", F.year("o_orderdate"), F.round(F.col("o_totalprice")).cast("bigint"))
    return rows.select("o_orderpriority", series.trend_sentence(F.col("o_orderpriority"), F.col("series")).alias("summary"), series.sparkline(F.col("series")).alias("svg"))


@query("SELECT event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cents_so_far FROM events")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("bigint")
    return ordering.running_sum(_stories(spark, folder), "user_id", ["ts", "event_id"], cents, "cents_so_far").select("event_id", "cents_so_far")


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 30) AS BIGINT) AS batch_no FROM documents")
def scoring_batches(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.batches(table(spark, folder, "documents").select("doc_id"), ["doc_id"], 30)


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(props, '') AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    c AS (SELECT user_id, event_id, n, repeat('0', 64) AS prev, sha256(repeat('0', 64) || '|' || body) AS hash FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, c.hash, sha256(c.hash || '|' || e.body) FROM e JOIN c ON e.user_id = c.user_id AND e.n = c.n + 1)"""


@query(_CHAIN + " SELECT user_id, event_id, prev, hash FROM c")
def audit_chains(spark: SparkSession, folder: str) -> DataFrame:
    return audit.build_chain(_stories(spark, folder), "user_id", "event_id", F.col("props"))


@query("SELECT user_id, count(*) AS entries, min(CASE WHEN event_type = 'error' THEN event_id END) AS first_bad FROM events GROUP BY user_id")
def audit_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Chains whose bodies of type error were changed afterwards: verification finds the first of them."""
    rows = _stories(spark, folder).withColumn("body", F.concat_ws(":", "event_type", F.coalesce("props", F.lit(""))))
    now = rows.select("event_id", F.when(F.col("event_type") == "error", F.lit("changed")).otherwise(F.col("body")).alias("body"))
    chain = audit.build_chain(rows, "user_id", "event_id", F.col("body")).join(now, "event_id")
    return audit.verify_chain(chain, "user_id", "event_id", "body")


_DOMAIN = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace({0}, '^[ \\t\\n\\r]+', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^([^/?#]*)', 1)), ':[0-9]+$', ''), '^www\\.', '')"


@query(f"""WITH d AS (SELECT DISTINCT {_DOMAIN.format('url')} AS d FROM sources WHERE tier = 1)
    SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM d WHERE {_DOMAIN.format('p.url')} = d.d OR {_DOMAIN.format('p.url')} LIKE '%.' || d.d)""")
def primary_pages(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "sources").where("tier = 1").select(domain(F.col("url")).alias("listed"))
    return publication.of_listed_domain(table(spark, folder, "pages").select("page_id", "url"), "url", listed, "listed").select("page_id")


@query("SELECT page_id, CAST(i - 1 AS INTEGER) AS place, links[i].href AS href, links[i].text AS anchor FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS i FROM pages)")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").select("page_id", F.posexplode("links").alias("place", "x"))
    return rows.select("page_id", "place", F.col("x.href").alias("href"), F.col("x.text").alias("anchor"))


@query()
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages").where("length(html) > 0").select("page_id", "html", "url"))
    rows = pages.select("page_id", page_extract(F.col("html"), F.col("url")).alias("x"))
    return rows.select("page_id", "x.text", "x.title", F.size("x.links").alias("links"))


@query("SELECT page_id, CASE WHEN headers['tdm-reservation'] = '1' THEN 'tdm-reservation header' ELSE '' END AS note FROM pages")
def page_reservations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", publication.reservation_note(F.col("headers"), F.lit(None).cast("map<string,string>")).alias("note"))


@query("SELECT sha256, min(page_id) AS page_id, count(*) AS fetches FROM pages WHERE length(html) > 0 GROUP BY sha256")
def page_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where("length(html) > 0")
    return rows.groupBy("sha256").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("fetches"))


@query()
def title_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").select("ord", X.slug(F.col("title")).alias("slug"))


@query("""SELECT "group", name, role, CAST(r AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY w, s) AS r FROM (
    SELECT cluster AS "group", lower(source_name), arg_min(source_name, w * 1000000000000 + ord) AS name, arg_min(role, w * 1000000000000 + ord) AS role, min(w) AS w, arg_min(ord, w * 1000000000000 + ord) AS s
    FROM (SELECT *, CASE WHEN tier <= 2 AND rights IN ('LICENSED', 'PRIMARY_PUBLIC') THEN 'primary' ELSE 'lead' END AS role, CASE WHEN tier <= 2 AND rights IN ('LICENSED', 'PRIMARY_PUBLIC') THEN 0 ELSE 2 END AS w FROM candidates WHERE cluster IS NOT NULL AND source_name IS NOT NULL)
    GROUP BY cluster, lower(source_name))) WHERE r <= 4""")
def cluster_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").select(F.col("cluster").alias("group"), F.col("source_name").alias("name"), evidence.source_role(F.col("rights"), F.col("tier")).alias("role"), "ord")
    return publication.ranked_sources(rows, "group", "name", "role", "ord")


@query("""SELECT s.id AS source_id, coalesce(c.items, 0) AS items, coalesce(c.titled, 0) AS titled, coalesce(c.titled, 0) > 0 AS ok FROM sources s
    LEFT JOIN (SELECT source_id, count(*) AS items, count(*) FILTER (WHERE length(title) > 0) AS titled FROM candidates GROUP BY 1) c ON s.id = c.source_id""")
def feed_health(spark: SparkSession, folder: str) -> DataFrame:
    return monitoring.feed_health(table(spark, folder, "candidates"), table(spark, folder, "sources"), "source_id", "id")


@query("""SELECT kind, count(*) AS entries FROM (SELECT 'document' AS kind, url FROM documents WHERE url IS NOT NULL UNION SELECT 'page', url FROM pages WHERE url IS NOT NULL) GROUP BY kind""")
def sitemap_families(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).where("url IS NOT NULL").select(F.lit(k).alias("kind"), "url") for k, t in (("document", "documents"), ("page", "pages"))]
    return parts[0].unionByName(parts[1]).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))


def _escaped(column: str) -> str:
    return f"replace(replace(replace(coalesce({column}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("""SELECT page_id, '<url><loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc><lastmod>' || strftime(CAST(retrieved_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%d') || '</lastmod></url>' AS entry FROM pages WHERE url IS NOT NULL""")
def sitemap_entries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").where("url IS NOT NULL").select("page_id", publication.sitemap_entry(F.col("url"), F.col("retrieved_at")).alias("entry"))


@query("""SELECT ord, '<item><title>' || x(title) || '</title><link>' || x(url) || '</link><description>' || x(summary) || '</description><pubDate>' || coalesce(strftime(CAST(found_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%a, %d %b %Y %H:%M:%S +0000'), '') || '</pubDate></item>' AS item FROM candidates""".replace("x(title)", _escaped("title")).replace("x(url)", _escaped("url")).replace("x(summary)", _escaped("summary")))
def rss_items(spark: SparkSession, folder: str) -> DataFrame:
    item = publication.rss_item(F.col("title"), F.col("url"), F.col("summary"), F.col("found_at"))
    return table(spark, folder, "candidates").select("ord", item.alias("item"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    return _stories(spark, folder).select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""SELECT cluster, array_to_string(list_sort(list_distinct(flatten(list(sections_hint)))), ' ') AS sections, count(*) AS items FROM candidates WHERE cluster IS NOT NULL AND sections_hint IS NOT NULL GROUP BY cluster""")
def cluster_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("cluster IS NOT NULL AND sections_hint IS NOT NULL")
    counts = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("items"))
    each = rows.select("cluster", F.explode_outer("sections_hint").alias("s")).groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("s")), " ").alias("sections"))
    return each.join(counts, "cluster").select("cluster", "sections", "items")


@query("""SELECT ord, array_to_string(list_sort(list_intersect(c.sections_hint, s.sections)), ' ') AS common, len(list_filter(c.sections_hint, lambda x: NOT list_contains(s.sections, x))) AS added
    FROM candidates c JOIN sources s ON c.source_id = s.id WHERE c.sections_hint IS NOT NULL""")
def section_hints(spark: SparkSession, folder: str) -> DataFrame:
    sources = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "sections")
    rows = table(spark, folder, "candidates").where("sections_hint IS NOT NULL").select("ord", "source_id", "sections_hint").join(sources, "source_id")
    return rows.select("ord", F.array_join(F.array_sort(F.array_intersect("sections_hint", "sections")), " ").alias("common"), F.size(F.array_except("sections_hint", "sections")).alias("added"))


@query(f"SELECT doc_id, CAST(greatest(1, round_even(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda w: w <> '')) / 220.0, 0)) AS INTEGER) AS minutes FROM documents")
def reading_times(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.reading_minutes(F.col("text")).alias("minutes"))


@query("""SELECT ord, CASE WHEN length(summary) > 120 THEN regexp_replace(substr(summary, 1, 117), ' [^ ]*$', '') || '…' ELSE summary END AS subject FROM candidates WHERE summary IS NOT NULL""")
def subjects(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").where("summary IS NOT NULL").select("ord", X.ellipsize(F.col("summary")).alias("subject"))


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def streamed_first_events(spark: SparkSession, folder: str) -> DataFrame:
    """First events of each user and type, kept by a stream for longer than the table lasts; then counted by user."""
    like = table(spark, folder, "events")
    stream = streams.read_table(spark, f"{folder}/events.parquet", like).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    keyed = stream.withColumn("key", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    first = streams.run_to_table(streams.first_within(keyed, "key", "ts", "3650 days"), Scratch(spark, "stream").path)
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def streamed_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Closed days of a stream: those that the watermark has passed."""
    like = table(spark, folder, "events")
    stream = streams.read_table(spark, f"{folder}/events.parquet", like).select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.col("ts").cast("timestamp").alias("ts"))
    counts = streams.run_to_table(streams.window_counts(stream, "ts", "event_type", "cents"), Scratch(spark, "stream").path)
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").alias("cents"))


_PAGES = f"""pg AS (SELECT page, arg_max(r, page_id) AS r FROM (SELECT address AS page, page_id, struct_pack(status := status, text := text, links := links, reserved := coalesce(tdm_reserved, false)) AS r FROM {_ADDRESS.format('pages')}) GROUP BY page),
    ok AS (SELECT page, r.text AS text, r.links AS links, r.reserved AS reserved FROM pg WHERE r.status = 200 AND length(r.text) > 0)"""
_HOSTED = "lower(regexp_extract(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^([^/?#]*)', 1))"
_GATHERED = f"""WITH {_PAGES}, c AS (SELECT a.ord, a.address AS page, b.tier, b.rights, b.cluster FROM candidates b LEFT JOIN {_ADDRESS.format('candidates')} a ON a.ord = b.ord WHERE a.ord IS NOT NULL),
    d AS (SELECT DISTINCT {_DOMAIN.format('url')} AS d FROM sources WHERE tier = 1),
    own AS (SELECT c.*, ok.links FROM c JOIN ok ON c.page = ok.page),
    lk AS (SELECT ord, page AS mine, CAST(i AS BIGINT) AS i, links[i].href AS url FROM (SELECT ord, page, links, unnest(range(1, len(links) + 1)) AS i FROM own)),
    la AS (SELECT ord, mine, i, url, address FROM {_ADDRESS.format('lk')}),
    lx AS (SELECT ord, address AS page, min(i) AS i FROM la WHERE EXISTS (SELECT 1 FROM d WHERE {_DOMAIN.format('la.url')} = d.d OR {_DOMAIN.format('la.url')} LIKE '%.' || d.d)
        AND {_HOSTED.format('la.url')} <> {_HOSTED.format('la.mine')} AND address <> mine GROUP BY ord, address),
    ly AS (SELECT lx.*, row_number() OVER (PARTITION BY ord ORDER BY i) AS k FROM lx JOIN ok ON lx.page = ok.page),
    fp AS (SELECT cluster, page, min(ord) AS first_ord, arg_min(tier, ord) AS tier, arg_min(rights, ord) AS rights FROM c WHERE cluster IS NOT NULL GROUP BY cluster, page),
    fq AS (SELECT * FROM (SELECT fp.*, row_number() OVER (PARTITION BY cluster ORDER BY first_ord) AS k FROM fp JOIN ok ON fp.page = ok.page) WHERE k <= 8),
    u AS (SELECT ord, page, 0 AS stage, 0 AS place, CASE WHEN rights IN ('LICENSED', 'PRIMARY_PUBLIC') AND tier <= 2 THEN 'primary' ELSE 'lead' END AS role, CASE WHEN rights IN ('FACTS_ONLY', 'LINK_ONLY') THEN 'FACTS_ONLY' ELSE rights END AS rights FROM own
        UNION ALL SELECT ord, page, 1, k, 'primary', 'PRIMARY_PUBLIC' FROM ly WHERE k <= 2
        UNION ALL SELECT c.ord, fq.page, 2, fq.first_ord, 'corroborating', CASE WHEN fq.rights IN ('FACTS_ONLY', 'LINK_ONLY') THEN 'FACTS_ONLY' ELSE fq.rights END FROM c JOIN fq ON c.cluster = fq.cluster WHERE fq.page <> c.page),
    v AS (SELECT *, row_number() OVER (PARTITION BY ord, page ORDER BY stage, place) AS one FROM u),
    w AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY stage, place) AS n FROM v WHERE one = 1),
    g AS (SELECT ord, n, page, role, CASE WHEN reserved AND rights IS DISTINCT FROM 'LICENSED' THEN 'LINK_ONLY' ELSE rights END AS rights, text FROM w JOIN ok USING (page) WHERE n <= 5),
    docs AS (SELECT ord, n, page, role, rights, CASE WHEN rights IS NOT DISTINCT FROM 'LINK_ONLY' THEN '' ELSE substr(text, 1, 40000) END AS text, rights IS DISTINCT FROM 'LINK_ONLY' AND length(text) > 40000 AS truncated FROM g)"""


def _gathered(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "candidates").where("url IS NOT NULL").select("ord", feed_address(F.col("url")).alias("page"), "tier", "rights", "cluster")
    pages = table(spark, folder, "pages").select(feed_address(F.col("url")).alias("page"), "page_id", "status", "text", "title", "links", "tdm_reserved")
    listed = table(spark, folder, "sources").where("tier = 1").select(domain(F.col("url")).alias("listed"))
    return gathering.gather(items, pages, listed, feed_address)


@query(_GATHERED + " SELECT ord, CAST(n AS INTEGER) AS n, page, role, rights, CAST(length(text) AS INTEGER) AS chars, truncated FROM docs")
def gathered_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _gathered(spark, folder).select("ord", "n", "page", "role", "rights", F.length("text").alias("chars"), "truncated")


@query(_GATHERED + """ SELECT ord, sha256(string_agg('<document n="' || CAST(n AS VARCHAR) || '" rights="' || coalesce(rights, '') || '">' || chr(10) ||
    CASE WHEN rights = 'LINK_ONLY' THEN '[link only]' WHEN rights = 'FACTS_ONLY' THEN '[facts only]' ELSE text END || chr(10) || '</document>', chr(10) || chr(10) ORDER BY n)) AS digest FROM docs GROUP BY ord""")
def evidence_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return gathering.prompt(_gathered(spark, folder), with_facts=False).select("ord", F.sha2("prompt", 256).alias("digest"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(headers['content-type'], 'charset=([0-9A-Za-z_-]+)', 1), ''), 'utf-8') AS charset FROM pages")
def page_charsets(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.try_element_at("headers", F.lit("content-type"))
    return table(spark, folder, "pages").select("page_id", display.charset(kind).alias("charset"))


@query("""SELECT page_id, strftime(CAST(retrieved_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%d/%m/%Y') AS short, strftime(CAST(retrieved_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%-d %B %Y') AS long FROM pages WHERE retrieved_at IS NOT NULL""")
def page_dates(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where("retrieved_at IS NOT NULL")
    return rows.select("page_id", display.short_date(F.col("retrieved_at")).alias("short"), display.long_date(F.col("retrieved_at")).alias("long"))


@query("""SELECT section, CASE WHEN s = '' THEN 'News' WHEN s IN ('science-health', 'business-work') THEN array_to_string(w, ' & ') ELSE array_to_string(w, ' ') END AS name
    FROM (SELECT *, list_transform(list_filter(string_split(s, '-'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])) AS w FROM (SELECT DISTINCT section, trim(coalesce(section, ''), ' ') AS s FROM (SELECT unnest(sections_hint) AS section FROM candidates)))""")
def section_names(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").select(F.explode("sections_hint").alias("section")).distinct()
    return rows.select("section", display.section_name(F.col("section")).alias("name"))


@query("""SELECT ord, replace(regexp_replace(replace(regexp_replace(regexp_replace(replace(title, '...', '…'), '''([0-9]0s\\b)', '’\\1', 'g'), '(^|[\\s(\\[{—–/-])"', '\\1“', 'g'), '"', '”'), '(^|[\\s(\\[{—–/-])''([0-9A-Za-z_])', '\\1‘\\2', 'g'), '''', '’') AS shown
    FROM candidates WHERE title IS NOT NULL""")
def shown_titles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("title IS NOT NULL")
    return rows.select("ord", display.smart_quotes(F.col("title")).alias("shown"))


_METRIC = "(SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey AS DOUBLE) AS b, o_orderkey % 3 = 0 AS daily FROM orders)"


@query(f"SELECT o_orderkey, CASE WHEN NOT daily THEN round(a / greatest(a, b), 9) END AS before, CASE WHEN NOT daily THEN round(b / greatest(a, b), 9) END AS after, CASE WHEN NOT daily THEN 'per week' END AS unit FROM {_METRIC}")
def metric_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Two figures with their units as texts, taken apart again: lengths of bars, and the unit that both have."""
    euro = lambda c, u: F.concat(F.lit("€"), F.col(c).cast("string"), F.lit(" per "), u)
    before, after = euro("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "day").otherwise("week")), euro("o_orderkey", F.lit("week"))
    rows = table(spark, folder, "orders").select("o_orderkey", display.bar_scale(before, after).alias("x"), display.split_unit(before, after).alias("y"))
    return rows.select("o_orderkey", F.round("x.before", 9).alias("before"), F.round("x.after", 9).alias("after"), "y.unit")


@query("""SELECT ord, array_to_string(list_sort(list_distinct(list_concat(coalesce(c.sections_hint, []), coalesce(s.sections, [])))), ' ') AS sections FROM candidates c JOIN sources s ON c.source_id = s.id""")
def all_sections(spark: SparkSession, folder: str) -> DataFrame:
    none = F.array().cast("array<string>")
    sources = table(spark, folder, "sources").select(F.col("id").alias("source_id"), F.coalesce("sections", none).alias("sections"))
    rows = table(spark, folder, "candidates").select("ord", "source_id", F.coalesce("sections_hint", none).alias("hint")).join(sources, "source_id")
    return rows.select("ord", F.array_join(F.array_sort(F.array_union("hint", "sections")), " ").alias("sections"))


@query("SELECT DISTINCT doc_id FROM (" + SQL["claim_verification"] + ") WHERE why IS NULL AND doc_id IS NOT NULL")
def claimed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that a kept claim names."""
    claims, docs = _facts(spark, folder)
    kept = evidence.verify_claims(claims, docs, "page", "ord", "summary", "doc_id").where("why IS NULL")
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id")


@query("""SELECT count(*) AS feeds, count(*) FILTER (WHERE n > 0) AS working, CAST(coalesce(sum(n), 0) AS BIGINT) AS titled, count(*) FILTER (WHERE n = 0) AS silent
    FROM (SELECT s.id, (SELECT count(*) FROM candidates c WHERE c.source_id = s.id AND length(c.title) > 0) AS n FROM sources s)""")
def feed_totals(spark: SparkSession, folder: str) -> DataFrame:
    health = monitoring.feed_health(table(spark, folder, "candidates"), table(spark, folder, "sources"), "source_id", "id")
    return health.agg(F.count(F.lit(1)).alias("feeds"), F.count_if("ok").alias("working"), F.coalesce(F.sum("titled"), F.lit(0)).alias("titled"), F.count_if(~F.col("ok")).alias("silent"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 12")
def latest_stories(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the newest twelve; identifiers settle ties."""
    return _stories(spark, folder).orderBy(F.desc("ts"), "event_id").limit(12).select("event_id", "ts")


@query("""WITH t AS (SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 3) SELECT event_id, ts FROM events WHERE event_id NOT IN (SELECT event_id FROM t) ORDER BY ts DESC, event_id LIMIT 4""")
def also_moving(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the newest four of those that aren't the three strongest."""
    rows = _stories(spark, folder)
    top = rows.orderBy(F.desc("value"), "event_id").limit(3)
    return publication.also_moving(rows, top, "event_id", [F.desc("ts"), F.col("event_id")], 4).select("event_id", "ts")


@query("""SELECT page_id, CAST(len(links) * 40 // 60 + 1 AS INTEGER) AS minutes, array_to_string(list_transform(links[1:3], lambda x: x.href), ' ') AS first_three, links[len(links)].href AS last FROM pages WHERE len(links) > 0""")
def link_slices(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages").where(F.size("links") > 0)
    three = F.array_join(F.transform(F.slice("links", 1, 3), lambda x: x["href"]), " ")
    return rows.select("page_id", display.reading_pace(F.size("links")).alias("minutes"), three.alias("first_three"), F.try_element_at("links", F.lit(-1))["href"].alias("last"))


_XML = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT sha256('<urlset>' || string_agg(e, '' ORDER BY retrieved_at DESC, page_id) || '</urlset>') AS digest FROM (SELECT page_id, retrieved_at, '<url><loc>' || {_XML.replace('{0}', 'url')} || '</loc><lastmod>' ||
    strftime(CAST(retrieved_at AT TIME ZONE 'UTC' AS TIMESTAMP), '%Y-%m-%d') || '</lastmod></url>' AS e FROM pages WHERE url IS NOT NULL AND retrieved_at IS NOT NULL ORDER BY retrieved_at DESC, page_id LIMIT 50)""")
def newest_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: a site map of the 50 pages fetched last, as one document."""
    rows = table(spark, folder, "pages").where("url IS NOT NULL AND retrieved_at IS NOT NULL")
    made = publication.joined(rows, publication.sitemap_entry(F.col("url"), F.col("retrieved_at")), [F.desc("retrieved_at"), F.col("page_id")], 50, "<urlset>", "</urlset>")
    return made.select(F.sha2("document", 256).alias("digest"))


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS version FROM events WHERE event_type = 'error'""")
def version_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stories(spark, folder).where("event_type = 'error'").withColumn("at", F.struct("ts", "event_id"))
    return files.append_versions(rows, None, "user_id", "at").select("user_id", "event_id", "version")


@query("""SELECT cluster, array_to_string(list_sort(list(DISTINCT problem)), '; ') AS problems FROM (SELECT cluster, unnest([CASE WHEN coalesce(title, '') = '' THEN 'no title' END, CASE WHEN coalesce(url, '') = '' THEN 'no address' END]) AS problem
    FROM candidates WHERE cluster IS NOT NULL) WHERE problem IS NOT NULL GROUP BY cluster""")
def cluster_problems(spark: SparkSession, folder: str) -> DataFrame:
    lacks = lambda c, text: F.when(F.coalesce(F.col(c), F.lit("")) == "", text)
    rows = table(spark, folder, "candidates").where("cluster IS NOT NULL").select("cluster", F.explode(F.array(lacks("title", "no title"), lacks("url", "no address"))).alias("problem"))
    return rows.where("problem IS NOT NULL").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))


@query()
def claimed_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """ord, n, claim, sentence: the first eight sentences with a figure of an item's readable documents, numbered over them."""
    docs = _gathered(spark, folder).where(F.col("rights").isin(*evidence.READABLE))
    each = docs.select("ord", "n", F.posexplode(X.plain_sentences(F.col("text"))).alias("place", "sentence")).where(F.rlike("sentence", F.lit("[0-9]")))
    return ordering.first_in_group(each, ["ord"], [F.col("n"), F.col("place")], 8, "claim").select("ord", "n", "claim", "sentence")
