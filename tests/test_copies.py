from pyspark.sql import functions as F

from quern.operators import evidence


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_repeated_runs_count_once(spark):
    drafts = [(1, "a b c d"), (2, "a b c a b c"), (3, "x y z"), (4, "a b"), (5, None), (6, "b c a")]
    sources = [("A, b c.",), ("c a b",), ("a b c",), (None,), ("z",)]
    got = evidence.copied_runs(spark.createDataFrame(drafts, "n INT, d STRING"), spark.createDataFrame(sources, "t STRING"), "n", "d", "t", 3)
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1), (2, 3, 2), (3, 1, 0), (6, 1, 0)}


def test_a_run_is_shuffled_once_in_few_bytes(spark):
    """13 runs of each of 2,000 texts on both sides."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.lit("w"), (F.col("id") * 24 + i).cast("string"))), " ")
    df = spark.range(2000).select("id", words.alias("text")).repartition(4)
    before = shuffled(spark)
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as large tables are joined
    try:
        got = evidence.copied_runs(df, df, "id", "text", "text", 12)
        assert got.where("runs = 13 AND copied = 13").count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert (shuffled(spark) - before) / (2 * 13 * 2000) < 32
