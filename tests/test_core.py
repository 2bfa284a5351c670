import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import html, text as X, url as U
from quern.operators import audit, checks, discovery, evidence, monitoring, ordering, publication, series
from quern.sources import feeds, files


def one(spark, column, **values):
    schema = ", ".join(f"{k} STRING" for k in values) or "x STRING"
    return spark.createDataFrame([tuple(values.values()) or (None,)], schema).select(column.alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, X.norm_space(F.col("t")), t=" “A”  –\n b’s ") == "\"A\" - b's"
    assert one(spark, X.topic_words(F.col("t")), t="The Owls of the North win: Owls, 42 of 100") == ["owls", "north", "win", "100"]
    assert one(spark, X.shingles(X.tokens(F.col("t")), 3), t="a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert one(spark, X.shingles(X.tokens(F.col("t")), 3), t="a b") == []
    assert one(spark, X.years(F.col("t")), t="In 1999 and 2026, not 12026 or 3000; 1999.") == ["1999", "2026"]
    assert one(spark, X.day_months(F.col("t")), t="On 3 October and October 4, 3rd October") == ["3 october", "4 october"]
    assert one(spark, X.relative_dates(F.col("t")), t="Yesterday, last week, yesterday") == ["last week", "yesterday"]
    assert [(f["surface"], f["value"]) for f in one(spark, X.figures(F.col("t")), t="€1.5 million, 1,486,000 and 47% of twenty thousand, one")] == [("€1.5 million", 1.5e6), ("1,486,000", 1486000.0), ("47%", 47.0), ("twenty thousand", 20000.0)]
    assert one(spark, X.quotations(F.col("t")), t="He said “we did not expect this.” and “no way at.”") == ["we did not expect this"]
    assert one(spark, X.capital_runs(F.col("t")), t="Then Anna van Dam met the Bank of Ireland today") == ["Then Anna van Dam", "Bank of Ireland"]
    assert one(spark, X.ellipsize(F.col("t"), 20, 15), t="some words that are too long") == "some words…"
    assert one(spark, X.chunks(F.split("t", r"\|"), 10), t="aaaa|bbb|cccccccccccc|d|e") == ["aaaa bbb", "cccccccccccc", "d e"]
    assert one(spark, X.reading_minutes(F.col("t")), t=None) == 1 and one(spark, X.reading_minutes(F.col("t")), t="w " * 550) == 2
    assert [X.slug_of(t) for t in ("Łódź: Ó!", "", "a" * 70, "one two three " * 9)] == ["odz-o", "item", "a" * 60, "one-two-three-one-two-three-one-two-three-one-two-three-one"]
    assert one(spark, X.slug(F.col("t")), t="Éire – 100%") == "eire-100"


def test_addresses(spark):
    same = ["https://x.example/a/B?id=1&sec=c", "HTTP://www.X.Example:80/a//B/?sec=c&utm_source=f&id=1#top", " https://amp.x.example/%61/B/index.html?id=1&sid=9&sec=c\t"]
    assert {one(spark, U.page_address(F.col("t")), t=t) for t in same} == {"x.example/a/B?id=1&sec=c"}
    assert one(spark, U.page_address(F.col("t")), t="https://x.example/a/b?id=1") == "x.example/a/b?id=1"
    assert one(spark, U.page_address(F.col("t")), t=" ") is None and one(spark, U.page_address(F.col("t")), t=None) is None
    assert one(spark, U.page_address(F.col("t")), t="x.example/%2Fa+b") == "x.example/%2Fa+b"
    assert one(spark, U.feed_address(F.col("t")), t="HTTPS://A.example/P/?b=2&utm_x=1&a=&c=3#f") == "https://a.example/P?b=2&c=3"
    assert one(spark, U.feed_address(F.col("t")), t="a.example") == "https://a.example/"
    assert one(spark, U.domain_suffixes(F.col("t")), t="a.b.c") == ["a.b.c", "b.c", "c"]


def test_page_reading():
    page = '<title>T t</title><nav><p>menu</p></nav><script>x</p></script><h1>Head</h1><p>One <a href="/l">link</a><br>two</p><li>x</li><meta name="Robots" content="noai"><p>open'
    got = html.extract(page, "https://a.example/b/")
    assert got["text"] == "Head\n\nOne link two" and got["title"] == "T t" and got["links"] == [{"href": "https://a.example/l", "text": "link"}] and got["meta"] == [("robots", "noai")]
    assert html.extract(None, None)["text"] == "" and html.extract("<", "")["links"] == []


def test_reservations(spark):
    row = spark.sql("SELECT map('TDM-Reservation', '1') AS h, map('robots', 'index, noai') AS m, CAST(NULL AS MAP<STRING, STRING>) AS n")
    assert row.select(publication.reservation_note(F.col("h"), F.col("m")).alias("x"), publication.reservation_note(F.col("n"), F.col("n")).alias("y")).first().asDict() == {"x": "tdm-reservation header; robots noai meta", "y": ""}


EVIDENCE = "In 2026, 47% of 1,486,000 homes took part, up from 38 per cent on 3 October. “We did not expect this so soon,” said Anna Murphy."


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (checks.numbers, "47%, 38 per cent and 1,486,000; about 1.5 million", "52% took part"),
        (checks.numbers, "about 1.5 million homes", "1.6 million homes"),
        (checks.dates, "On 3 October 2026", "On 4 October"),
        (checks.dates, "In 2026", "yesterday"),
        (checks.quotes, "She said “we did not expect this so soon”.", "She said “we did expect this so soon”."),
        (checks.entities, "Anna Murphy said", "Anna Murphy met Bob Kelly"),
        (checks.hype, "a good day", "a breakthrough"),
    ],
)
def test_checks(spark, check, good, bad):
    frame = spark.createDataFrame([(good, EVIDENCE), (bad, EVIDENCE)], "d STRING, e STRING")
    got = [r.x.status for r in frame.select(check(F.col("d"), F.col("e")).alias("x")).collect()]
    assert got == ["pass", "warn" if check is checks.entities else "fail"]


def test_copying_and_structure(spark):
    source = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(source, [source]), (f"“{source}” he said and went home", [source]), ("nothing of that kind was said here at all by anyone", ["", source])]
    got = spark.createDataFrame(rows, "d STRING, s ARRAY<STRING>").select(checks.copying(F.col("d"), F.col("s")).alias("x")).collect()
    assert [r.x.status for r in got] == ["fail", "pass", "pass"] and len(got[0].x.details) == 2
    frame = spark.createDataFrame([("word " * 10, None, False), ("word " * 200, "t", True)], "b STRING, t STRING, p BOOLEAN")
    assert [r.x.details for r in frame.select(checks.structure(F.col("b"), F.col("t"), F.col("p")).alias("x")).collect()] == [["article under 120 words", "missing title", "no primary source"], []]


def test_title_clusters_follow_the_first_similar_row(spark):
    rows = [(1, "otters return river bank north"), (2, "otters return river bank south"), (3, "otters return river lake south"), (4, "quite other things"), (5, ""), (6, None), (7, "of the"), (8, "north bank river return otters"), (2, "otters return river bank south")]
    got = {r.ord: r.cluster for r in discovery.title_clusters(spark.createDataFrame(rows, "ord BIGINT, title STRING")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 7: 7, 8: 1}
    assert discovery.title_clusters(spark.createDataFrame([], "ord BIGINT, title STRING")).collect() == []


def test_unseen_takes_the_first_row_of_a_new_key(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "ord BIGINT, key STRING")
    assert {tuple(r) for r in discovery.unseen(rows, spark.createDataFrame([("b",), (None,)], "key STRING")).select("key", "ord").collect()} == {("a", 1)}


def test_claims_and_corroboration(spark):
    docs = spark.createDataFrame([("k", 1, "A b c.", "FACTS_ONLY"), ("k", 2, "x A b", "PRIMARY_PUBLIC"), ("k", 3, "c. y", "LICENSED")], "key STRING, n INT, text STRING, rights STRING")
    claims = spark.createDataFrame([("k", "c1", "a B C."), ("k", "c2", "nope"), ("z", "c3", "a")], "key STRING, id STRING, span STRING")
    got = {(r.id, r.n): r.why for r in evidence.verify_claims(claims, docs, "key", "id", "span", "n").collect()}
    assert got[("c1", 1)] is None and got[("c1", 2)] and got[("c2", 3)] and got[("c3", None)]
    items = spark.createDataFrame([("a", "o1", 1, "LICENSED"), ("b", "o1", 2, "LICENSED"), ("b", "o2", 2, "LICENSED"), ("c", None, 4, None)], "c STRING, o STRING, tier INT, rights STRING")
    assert {r.c: r["class"] for r in evidence.corroboration(items, "c", F.col("o"), F.col("tier"), F.col("rights")).collect()} == {"a": "primary_confirmed", "b": "two_independent", "c": "single_source"}


def test_orders(spark):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 7).repartition(5)
    assert [r.row_no for r in ordering.global_row_number(df, ["id"]).orderBy("id").collect()] == list(range(1, 1001))
    assert ordering.batches(df, ["id"], 30).groupBy("batch_no").count().where("count > 30").count() == 0
    assert [r.id for r in ordering.top_or_all(df, F.col("id") > 5000, [F.desc("id")], 2).collect()] == [999, 998]
    assert {r.id: r.others for r in ordering.related(df, "g", "id", [F.desc("id")], 2).collect()}[999] == [992, 985]
    assert ordering.global_row_number(df.limit(0), ["id"]).collect() == []


def test_series(spark):
    df = spark.createDataFrame([("a", 2020, 5.0), ("a", 2022, 2.0), ("a", 2021, 9.0), ("b", 2020, 1.0)], "k STRING, y INT, v DOUBLE")
    rows = series.yearly_series(df, "k", F.col("y"), F.col("v")).select("k", series.series_facts(F.col("series")).alias("f"), series.trend_sentence(F.col("k"), F.col("series")).alias("t"), series.sparkline(F.col("series")).alias("s"))
    got = {r.k: r for r in rows.collect()}
    assert (got["a"].f.first, got["a"].f.last, got["a"].f.least, got["a"].f.greatest, got["a"].f.trend) == (5.0, 2.0, 2.0, 9.0, "fell")
    assert got["a"].t == "a: Fell from 5.00 in 2020 to 2.00 in 2022 (the wrong way)." and got["b"].t is None and got["b"].s == "" and got["a"].s.startswith("<svg")


def test_chain(spark):
    df = spark.createDataFrame([("l", 1, "x"), ("l", 2, "y"), ("l", 3, None)], "log STRING, n INT, b STRING")
    chain = audit.build_chain(df, "log", "n", F.col("b"))
    rows = {r.n: r for r in chain.collect()}
    assert rows[1].hash == hashlib.sha256(f"{audit.GENESIS}|x".encode()).hexdigest() and rows[3].prev == rows[2].hash
    body = df.select("n", F.coalesce("b", F.lit("")).alias("b"))
    assert audit.verify_chain(chain.join(body, "n"), "log", "n", "b").first().first_bad is None
    assert audit.verify_chain(chain.join(body.withColumn("b", F.when(F.col("n") == 2, "z").otherwise(F.col("b"))), "n"), "log", "n", "b").first().first_bad == 2


def test_log_lines(spark):
    lines, prev = [], audit.GENESIS
    for i in range(3):
        entry = {"at": f"t{i}", "action": "é", "prev": prev}
        digest = hashlib.sha256(json.dumps(entry, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        lines.append(("l", i, json.dumps(entry | {"hash": digest}, ensure_ascii=False)))
        prev = digest
    bad = lines[:1] + [("l", 1, lines[1][2].replace("é", "e"))] + lines[2:]
    broken = [("m", 0, "not json")]
    got = {tuple(r) for r in audit.verify_log_lines(spark.createDataFrame(bad + broken, "log STRING, n INT, line STRING"), "log", "n", "line").collect()}
    assert got == {("l", 3, 1), ("m", 1, 0)}


def test_monitoring(spark):
    at = lambda c: F.col(c).cast("timestamp")
    df = spark.createDataFrame([("2026-01-01 00:00", None), ("2026-01-01 00:00", "2026-01-02 01:00"), ("2026-01-02 06:00", None)], "p STRING, c STRING")
    got = [r.m for r in df.select(monitoring.due_mark(at("p"), at("c"), F.lit("2026-01-02 10:00").cast("timestamp")).alias("m")).collect()]
    assert got == [24, None, None]
    claims = spark.createDataFrame([("u", 1, "a b"), ("v", 2, "a"), ("w", 3, "a"), ("u", 4, "zz")], "url STRING, id INT, span STRING")
    pages = spark.createDataFrame([("u", 200, "A  b"), ("v", 404, "")], "url STRING, status INT, text STRING")
    assert {r.id: (r.problem or "")[:10] for r in monitoring.recheck(claims, pages, "url", "id", "span").collect()} == {1: "", 2: "source is ", 3: "source can", 4: "passage no"}


def test_ranked_sources(spark):
    rows = [("g", "Ann", "lead", 1), ("g", "ANN", "primary", 2), ("g", "Bob", "other", 3), ("g", None, "lead", 4), (None, "Cy", "lead", 5)]
    got = publication.ranked_sources(spark.createDataFrame(rows, "g STRING, name STRING, role STRING, o INT"), "g", "name", "role", "o").collect()
    assert {(r.name, r.role, r.rank_no) for r in got} == {("ANN", "primary", 1), ("Bob", "other", 2)}


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>https://x.example/1</link><description>&lt;p&gt;Hi  there&lt;/p&gt;</description><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed><entry><title>C</title><link href="https://x.example/2"/><summary>s</summary><updated>u</updated></entry></feed>')
    (tmp_path / "c.json").write_text(json.dumps({"articles": [{"url": "https://x.example/3", "title": "D"}, {"title": "none"}]}))
    (tmp_path / "d.json").write_text("{broken")
    parts = [feeds.read_rss(spark, f"{tmp_path}/a.xml", "s1"), feeds.read_atom(spark, f"{tmp_path}/b.xml", "s2"), feeds.read_articles(spark, f"{tmp_path}/*.json", "s3")]
    sources = spark.createDataFrame([("s1", 1, "LICENSED", "One", ["x"], "o"), ("s2", 2, "RESTRICTED", "Two", None, None)], "id STRING, tier INT, rights STRING, name STRING, sections ARRAY<STRING>, owner_org STRING")
    got = {r.source_id: r for r in feeds.with_source_defaults(feeds.union_feeds(parts), sources).collect()}
    assert set(got) == {"s1", "s3"} and got["s1"].title == "A & B" and got["s1"].summary == "Hi there" and (got["s3"].tier, got["s3"].rights, got["s3"].source_name) == (4, "LINK_ONLY", "s3")


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.md").write_text("---\ntitle: T\ntags: [a]\n---\nBody\n---\nmore")
    (tmp_path / "s/b.md").write_text("no front")
    got = {r.path[-4:]: r for r in files.read_front_matter(spark, f"{tmp_path}/s").collect()}
    assert got["a.md"].meta["title"] == "T" and got["a.md"].body == "Body\n---\nmore" and got["b.md"].body == "no front"
    (tmp_path / "x.csv").write_text("e,c,y,v\nA,a,2020,1.5\nB,b,x,2\n")
    assert [tuple(r) for r in files.read_series(spark, f"{tmp_path}/x.csv", "missing").collect()] == [("A", 2020, 1.5)]
    pages = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), (None, "c")], "sha256 STRING, html STRING")
    assert files.append_snapshots(pages, f"{tmp_path}/snap") == 2 and files.append_snapshots(pages, f"{tmp_path}/snap") == 0
    versions = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "c")], "k STRING, v INT, t STRING")
    assert {(r.k, r.t) for r in files.latest_versions(versions, "k", "v").collect()} == {("k", "b"), ("l", "c")}
