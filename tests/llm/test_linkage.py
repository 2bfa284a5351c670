from quern.llm.linkage import FIELDS, LinkStore, history_records, learn, link_batches, repeated_rows

SEEN = "url_key STRING, url STRING, first_seen STRING"
ROWS = "ord BIGINT, batch INT, url STRING, id STRING, key STRING, node INT"


def rows():
    return [
        (1, 1, "https://x.example/a", "AA", "k", 1),
        (2, 1, "http://www.x.example/a/?utm_source=f", None, "k", 1),  # address of 1
        (3, 1, None, "aa", "k", 1),  # id of 1
        (4, 1, "https://x.example/A", None, "k", 1),  # another page
        (5, 2, "https://x.example/s/b?id=2&sec=c", "h1", "k", 1),  # id in history
        (6, 2, "https://x.example/hist", None, "k", 1),  # address in history
        (7, 2, None, None, None, None),
        (8, None, "https://x.example/new", "cc", "k", 1),
        (9, 3, "https://x.example/new#top", "dd", "k", 1),  # address of 8, another id
        (10, 3, "https://x.example/b", "DD", "k", 1),  # id of 9: a chain
        (11, 3, " ", " ", "k", 1),
    ]


def test_repeats(spark):
    seen = spark.createDataFrame([("h1", "https://x.example/h", None), (None, "https://m.x.example/hist", None), ("h3", None, "x"), ("h1", "https://x.example/h", "x")], SEEN)
    for step in (1, 2, 10):
        got = repeated_rows(seen, spark.createDataFrame(rows(), ROWS), batches_per_step=step)
        assert sorted(r.ord for r in got.collect()) == [2, 3, 5, 6, 9, 10], step


def test_later_runs_use_what_is_stored(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    seen = spark.createDataFrame([("h1", None, None)], SEEN)
    df = spark.createDataFrame(rows(), ROWS)
    first = repeated_rows(seen, df.where("ord <= 4"), folder)
    assert sorted(r.ord for r in first.collect()) == [2, 3]
    store = LinkStore(spark, folder)
    assert store.steps == [0, 1] and set(store.weights) == {"id", "site", "path", "query"} and store.weights["id"]["agree"] > 0 >= store.weights["path"]["differ"]
    link_batches(store, df.where("ord > 4"))
    assert sorted(r.node for r in store.parents().where("direct").collect()) == [2, 3, 5, 9, 10]
    assert {r.node: r.root for r in store.find().where("node >= 0").collect()} | {5: 0} == {2: 1, 3: 1, 5: 0, 9: 8, 10: 8}


def test_every_parent_of_a_record_counts(spark, tmp_path):
    rows = [(0, "y", None), (1, "z", "https://x.example/B"), (2, "x", "https://x.example/B"), (3, "y", "https://x.example/A"), (4, "x", "https://x.example/A")]
    df = spark.createDataFrame(rows, "node BIGINT, id STRING, url STRING")
    for name, steps in (("once", ["node >= 0"]), ("singly", [f"node = {k}" for k in range(5)])):
        store = LinkStore(spark, f"file://{tmp_path}/{name}")
        for part in steps:
            store.add(df.where(part))
        assert {r.node: r.root for r in store.find().collect()} == {1: 0, 2: 0, 3: 0, 4: 0}, name


def test_ids_without_any_address(spark):
    seen = spark.createDataFrame([("h1", None, None)], SEEN)
    df = spark.createDataFrame([(1, 1, None, "H1", "k", 1), (2, 1, " ", "aa", "k", 1), (3, 1, None, "AA", "k", 1), (4, 1, None, "bb", "k", 1)], ROWS)
    assert sorted(r.ord for r in repeated_rows(seen, df).collect()) == [1, 3]


def test_weights_decide(spark, tmp_path):
    """All of these pairs share a blocking key; only the weights tell the article's parameter from a shared path."""
    rows = [(k, f"i{k}", f"https://x.example/show?id={k // 2}") for k in range(40)] + [(50, None, "https://x.example/show?id=99")]
    store = LinkStore(spark, f"file://{tmp_path}/store")
    store.add(spark.createDataFrame(rows, "node BIGINT, id STRING, url STRING"))
    assert sorted(r.node for r in store.parents().where("direct").collect()) == list(range(1, 40, 2))
    assert (0, 1, 1, 0) in store.patterns and (None, 1, 1, 0) in store.patterns
    assert LinkStore(spark, store.folder).weights == store.weights


def test_learned_weights_put_every_pattern_on_its_side():
    sides = (1, 0, None)
    patterns = {(i, *a): 10 ** (k % 7) for k, i in enumerate(sides) for a in [(s, p, q) for s in (1, 0) for p in (1, 0) for q in (1, 0)] + [(None, None, None)]}
    bias, weights = learn(patterns)
    for a in patterns:
        score = bias + sum(weights[f]["agree"] if v == 1 else weights[f]["differ"] if v == 0 else 0 for f, v in zip(FIELDS, a))
        assert (score > 0) == (a[0] == 1 or a[1:] == (1, 1, 1)), a


def test_links_over_steps_are_kept(spark, tmp_path):
    rows = [(3, "p", None), (4, "q", "https://x.example/a"), (5, "q2", "https://x.example/a#x"), (6, "q2", None), (7, "p", None), (8, "P", "https://www.x.example/a")]
    df = spark.createDataFrame(rows, "node BIGINT, id STRING, url STRING")
    store = LinkStore(spark, f"file://{tmp_path}/store")
    for low, high in ((3, 5), (6, 6), (7, 8)):
        store.add(df.where(f"node BETWEEN {low} AND {high}"))
    assert {r.node: r.root for r in store.find().collect()} == {4: 3, 5: 3, 6: 3, 7: 3, 8: 3}


def test_a_step_that_was_cut_off_is_done_again(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    store = LinkStore(spark, folder)
    store.add(history_records(spark.createDataFrame([("h1", None, None)], SEEN)))
    (tmp_path / "store/keys/1").mkdir(parents=True)
    again = LinkStore(spark, folder)
    assert again.steps == [0] and again.keys().count() == 1


def test_empty(spark):
    none = spark.createDataFrame([], ROWS)
    assert repeated_rows(spark.createDataFrame([], SEEN), none).collect() == []
