import json

from pyspark.sql import functions as F

from quern.functions import display as D, text as X
from quern.operators import audit, checks, evidence, gathering, ordering, publication, series
from quern.sources import feeds, files
from tests.test_core import one


def test_display_functions(spark):
    assert one(spark, D.smart_quotes(F.col("t")), t="\"It's 'fine'...\" in the '90s (\"yes\")") == "“It’s ‘fine’…” in the ’90s (“yes”)"
    assert [one(spark, D.section_name(F.col("t")), t=t) for t in ("science-health", "top-progress", "", None)] == ["Science & Health", "Top Progress", "News", "News"]
    assert one(spark, D.section_name(F.col("t"), F.col("g")), t="world", g="The World") == "The World"
    assert one(spark, D.long_date(F.col("t").cast("date")), t="2026-01-05") == "5 January 2026" and one(spark, D.short_date(F.col("t").cast("date")), t="2026-01-05") == "05/01/2026"
    assert one(spark, D.item_id(F.col("d").cast("date"), F.col("t"), F.col("u")), d="2026-01-05", t="A title", u="x").startswith("2026-01-05-a-title-") and one(spark, D.slug_or_title(F.col("s"), F.col("t")), s=" ", t="A b") == "a-b"
    assert [one(spark, D.charset(F.col("t")), t=t) for t in ("text/html; charset=latin-1", "text/html", None)] == ["latin-1", "utf-8", "utf-8"]
    assert tuple(one(spark, D.quantity(F.col("t")), t="€1,480.5 per household")) == ("€", 1480.5, "per household") and one(spark, D.quantity(F.col("t")), t="none") is None
    assert tuple(one(spark, D.bar_scale(F.col("a"), F.col("b")), a="20%", b="50%")) == (0.2, 0.5) and tuple(one(spark, D.bar_scale(F.col("a"), F.col("b")), a="5 km", b="10 km")) == (0.5, 1.0)
    assert one(spark, D.bar_scale(F.col("a"), F.col("b")), a="5 km", b="10 m") is None
    assert tuple(one(spark, D.split_unit(F.col("a"), F.col("b")), a="€1 per day", b="€2 per day")) == ("€1", "€2", "per day") and one(spark, D.split_unit(F.col("a"), F.col("b")), a="1%", b="2%") is None
    assert one(spark, D.slide_texts(F.split("s", "x"), F.col("d"), F.split("c", r"\|"), F.col("t")), s=" ", d="dek", c="a|b|c|d|e", t="title") == ["dek", "a", "b", "c", "d"]
    assert one(spark, D.wrapped(F.col("t"), 7), t="aa bb cccccccc d e") == ["aa bb", "cccccccc", "d e"]
    assert D.clean_of("é​  b\r\n\n\n\nc­") == "é b\n\nc" and one(spark, D.clean_text(F.col("t")), t=None) == ""
    assert spark.range(1).select(D.reading_pace(F.lit(7))).first()[0] == 5
    assert one(spark, X.plain_sentences(F.col("t")), t="Short one. This sentence is long enough to be kept by far. “And this one too, since it is as long.”") == ["This sentence is long enough to be kept by far.", "“And this one too, since it is as long.”"]
    assert one(spark, X.display_sentences(F.col("t")), t="One. two. Three! 4 is “new.” Five") == ["One. two.", "Three!", "4 is “new.", "Five"]
    assert [one(spark, series.value_text(F.col("t").cast("double"), u), t=t) for t, u in (("2.25", "%"), ("1234.5", "km"), ("2.5", ""))] == ["2.2%", "1,234 km", "2.50"]


def test_gathered_documents(spark):
    link = lambda *urls: [(u, "a") for u in urls]
    pages = [
        ("a", 1, 200, "old", "t", [], False), ("a", 2, 200, "lead text", "t", link("b", "d1", "gone", "d2", "d3"), False), ("d1", 3, 200, "one", "t", [], True), ("d2", 4, 200, "two", "t", [], False),
        ("d3", 5, 200, "three", "t", [], None), ("gone", 6, 404, "x", "t", [], False), ("p1", 7, 200, "peer", "t", [], False), ("p2", 8, 200, "y" * 40_001, "t", [], False), ("p3", 9, 200, "z", "t", [], False), (None, 10, 200, "n", "t", [], False),
    ]
    frame = spark.createDataFrame(pages, "page STRING, page_id INT, status INT, text STRING, title STRING, links ARRAY<STRUCT<href: STRING, text: STRING>>, tdm_reserved BOOLEAN")
    to = lambda c: F.regexp_replace(c, "^https://x.gov/", "")
    frame = frame.withColumn("links", F.transform("links", lambda x: F.struct(F.concat(F.lit("https://x.gov/"), x["href"]).alias("href"), x["text"].alias("text"))))
    items = spark.createDataFrame([(1, "a", 3, "LINK_ONLY", "g"), (2, "p1", 1, "LICENSED", "g"), (3, "p2", 2, "LICENSED", "g"), (4, "p3", 2, None, "g"), (5, "nowhere", 1, "LICENSED", None), (6, "a", 3, "LICENSED", "g")], "ord BIGINT, page STRING, tier INT, rights STRING, cluster STRING")
    listed = spark.createDataFrame([("x.gov",)], "listed STRING")
    rows = gathering.gather(items, frame, listed, to).collect()
    got = {(r.ord, r.n): (r.page, r.role, r.rights, r.truncated) for r in rows}
    assert [got[(1, n)] for n in range(1, 6)] == [("a", "lead", "FACTS_ONLY", False), ("d1", "primary", "LINK_ONLY", False), ("d2", "primary", "PRIMARY_PUBLIC", False), ("p1", "corroborating", "LICENSED", False), ("p2", "corroborating", "LICENSED", True)]
    assert got[(2, 1)] == ("p1", "primary", "LICENSED", False) and got[(2, 2)][0] == "a" and (5, 1) not in got and (2, 5) not in got
    shown = {r.ord: r.prompt for r in gathering.prompt(spark.createDataFrame(rows), False).collect()}[1]
    assert shown.startswith('<document n="1" rights="FACTS_ONLY">\n[facts only]') and "[link only]" in shown and "two" in shown
    assert gathering.gather(items.limit(0), frame, listed, to).collect() == [] and gathering.gather(items, frame.limit(0), listed, to).collect() == []


def test_whole_checks(spark):
    row = spark.createDataFrame([("Bob Kelly met Anna Murphy", "Anna Murphy", ["Bob Kelly"], [" "])], "d STRING, e STRING, a ARRAY<STRING>, l ARRAY<STRING>")
    got = row.select(checks.entities(F.col("d"), F.col("e"), F.col("a")).alias("x"), checks.entities(F.col("d"), F.col("e"), F.lit(None).cast("array<string>")).alias("y"), checks.structure(F.col("d"), F.col("d"), F.lit(True), 1, 9, F.col("d"), F.lit(""), F.col("l")).alias("z"), checks.public_text(F.col("d"), F.lit(None).cast("string"), F.col("a")).alias("p")).first()
    assert got.x.status == "pass" and got.y.status == "warn" and got.z.details == ["missing why it matters", "no limitations stated"] and got.p == "Bob Kelly met Anna Murphy\nBob Kelly"
    every = checks.run_all(row.withColumn("s", F.array("e")), "d", "e", "s", structured=checks.structure(F.col("d"), F.col("d"), F.lit(False)))
    names = ["numbers", "dates", "quotes", "entities", "hype", "copying", "structure"]
    flat = every.select(checks.free_of_failures([F.col(n) for n in names]).alias("ok"), checks.as_map(names).alias("m")).first()
    assert not flat.ok and set(flat.m) == set(names) and flat.m["structure"].status == "fail"


def test_running_sum_and_chain_go_on(spark):
    df = spark.createDataFrame([(k % 3 or None, k, k) for k in range(200)] + [(7, k, 1) for k in range(1000, 1400)], "k INT, o INT, v INT").repartition(7)
    want, sums = {}, {}
    for k, o, v in sorted(((k % 3 or None, k, k) for k in range(200)), key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want[o] = sums[k]
    got = {r.o: r.s for r in ordering.running_sum(df, "k", ["o"], F.col("v"), "s").collect()}
    assert all(got[o] == s for o, s in want.items()) and got[1399] == 400
    rows = spark.createDataFrame([("l", k, f"b{k}") for k in range(6)] + [("m", 0, None)], "log STRING, n INT, b STRING")
    whole = {(r.log, r.n): r.hash for r in audit.build_chain(rows, "log", "n", F.col("b")).collect()}
    first = audit.build_chain(rows.where("n < 3"), "log", "n", F.col("b"))
    later = audit.build_chain(rows.where("n >= 3"), "log", "n", F.col("b"), audit.last_hashes(first, "log", "n"))
    assert {(r.log, r.n): r.hash for r in later.collect()} == {k: v for k, v in whole.items() if k[1] >= 3}


def test_publication_documents(spark):
    df = spark.createDataFrame([(1, "A & B"), (2, "C"), (3, "D")], "o INT, t STRING")
    assert publication.joined(df, F.col("t"), [F.desc("o")], 2, "<", ">").first().document == "<DC>" and publication.joined(df.limit(0), F.col("t"), [F.desc("o")], 2, "<", ">").first().document == "<>"
    entry = one(spark, publication.news_entry(F.col("u"), F.lit("P"), F.lit("en"), F.lit("2026-01-02 03:04:05").cast("timestamp"), F.col("t")), u="https://x/?a&b", t="<T>")
    assert "<loc>https://x/?a&amp;b</loc>" in entry and "2026-01-02T03:04:05Z" in entry and "&lt;T&gt;" in entry
    assert json.loads(one(spark, publication.json_ld("NewsArticle", headline=F.col("t"), gone=F.lit(None).cast("string")), t="H")) == {"@context": "https://schema.org", "@type": "NewsArticle", "headline": "H"}
    page = '<a href="/stories/x/">x</a><img src="/static/a.png"><a href="//cdn/x"><a href="/"><a href="/b/#c">'
    assert one(spark, publication.relative_links(F.col("t"), F.lit(2)), t=page) == '<a href="../../stories/x/index.html">x</a><img src="../../static/a.png"><a href="//cdn/x"><a href="../../index.html"><a href="../../b/index.html#c">'
    text = publication.issue_text(spark.createDataFrame([("s", "T", "b"), ("s", "T", "a"), ("s", "T", "b"), ("u", "U", None)], "k STRING, t STRING, p STRING"), "k", "t", "p").collect()
    assert [r.text for r in text] == ["### T\n- a\n- b"]
    rules = spark.createDataFrame([("x.example", "/private/*", "1"), ("y.example", None, "1"), ("z.example", "/", "0")], "host STRING, location STRING, reserved STRING")
    urls = spark.createDataFrame([("https://x.example/private/a",), ("https://x.example/b",), ("https://Y.example/q",), ("https://z.example/",), (None,)], "url STRING")
    found = {r.url: r.reserved for r in publication.reserved_by_rules(urls, "url", rules).collect()}
    assert found == {"https://x.example/private/a": True, "https://x.example/b": False, "https://Y.example/q": True, "https://z.example/": False, None: False}
    robots = "User-agent: *\nDisallow: /no/"
    assert [one(spark, publication.robots_allow(F.col("r"), "bot", F.col("u")), r=r, u=u) for r, u in ((robots, "https://x/no/a"), (robots, "https://x/a"), (None, "https://x/no/a"))] == [False, True, True]
    assert [r.o for r in publication.also_moving(df, df.where("o = 3"), "o", [F.desc("o")], 1).collect()] == [2]
    docs = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key STRING, n INT, t STRING")
    assert [r.n for r in evidence.used_sources(docs.where("n = 2"), docs, "key", "n").collect()] == [2]


def test_more_files(spark, tmp_path):
    (tmp_path / "q/one").mkdir(parents=True)
    (tmp_path / "q/one/story.md").write_text("---\ntitle: T\n---\nB")
    (tmp_path / "q/other.md").write_text("---\ntitle: U\n---\nB")
    assert [r.meta["title"] for r in files.read_queue(spark, f"{tmp_path}/q").collect()] == ["T"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/b.md").write_text("---\ngroup: a\norder: 2\n---\nHi {{ name }}")
    (tmp_path / "p/a.md").write_text("---\nslug: own\n---\nx")
    (tmp_path / "p/c.md").write_text("no front matter")
    got = files.read_pages(spark, f"{tmp_path}/p", {"name": "a$1\\"}).collect()
    assert [(r.slug, r.group, r.order, r.body) for r in got] == [("b", "a", 2, "Hi a$1\\"), ("own", "z", 99, "x")]
    assert [r.path[-4:] for r in files.in_path_order(files.read_front_matter(spark, f"{tmp_path}/p")).collect()] == ["a.md", "b.md", "c.md"]
    assert len(files.read_versioned_texts(spark, f"{tmp_path}/p/a.md").first().version) == 12
    (tmp_path / "f").mkdir()
    (tmp_path / "f/index.json").write_text(json.dumps({"https://x/1": "1.html", "https://x/2": "2.html"}))
    (tmp_path / "f/1.html").write_text("<p>one</p>")
    assert {tuple(r) for r in files.read_fixture_pages(spark, f"{tmp_path}/f").collect()} == {("https://x/1", 200, "<p>one</p>"), ("https://x/2", 404, "")}
    assert files.read_documents(spark, f"{tmp_path}/none", "a INT").collect() == [] and files.read_documents(spark, f"{tmp_path}/f/index.json", "a INT").count() == 1
    (tmp_path / "s.yaml").write_text("sources:\n- {id: a, tier: 1}\n- {id: b}\n")
    table = files.register(spark, files.read_settings(f"{tmp_path}/s.yaml"), "sources", "id STRING, tier INT")
    assert [tuple(r) for r in table.orderBy("id").collect()] == [("a", 1), ("b", None)] and files.the_one(table, F.col("id") == "a") == {"id": "a", "tier": 1}
    (tmp_path / "l.jsonl").write_text("x\n\ny\n")
    assert [(r.n, r.line) for r in files.read_numbered_lines(spark, f"{tmp_path}/l.jsonl").orderBy("n").collect()] == [(1, "x"), (2, "y")]
    files.append_log(table, f"{tmp_path}/log")
    files.append_log(table, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    meta = spark.sql("SELECT 'x/y.md' AS name, map('title', 'T: é') AS m, ' B ' AS b")
    files.write_texts(meta.select("name", files.front_matter_text(F.col("m"), F.col("b")).alias("t")), "name", "t", f"{tmp_path}/out")
    back = files.read_front_matter(spark, f"{tmp_path}/out").first()
    assert back.meta == {"title": "T: é"} and back.body == "B"
    changes = spark.createDataFrame([("k", 5), ("k", 4), ("n", 1)], "k STRING, t INT")
    store = spark.createDataFrame([("k", 1, 2)], "k STRING, t INT, version INT")
    assert {(r.k, r.t): r.version for r in files.append_versions(changes, store, "k", "t").collect()} == {("k", 4): 3, ("k", 5): 4, ("n", 1): 1}


def test_a_failing_feed_stops_no_other(spark):
    good = lambda: spark.createDataFrame([("s1", "u")], "source_id STRING, url STRING")

    def bad():
        raise OSError("no such feed")

    sources = spark.createDataFrame([("s1", None), ("s2", None), ("s3", "RESTRICTED"), ("s4", None)], "id STRING, rights STRING")
    rows, errors = feeds.read_all({"s1": good, "s2": bad, "s3": bad, "s4": bad}, sources, only=["s1", "s2", "s3"])
    assert rows.count() == 1 and errors == {"s2": "no such feed"}
    assert feeds.read_all({"s2": bad}, sources)[0] is None
