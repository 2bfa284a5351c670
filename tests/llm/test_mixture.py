import pytest
from pyspark.sql import functions as F

from quern.llm.mixture import Mix, copies_of, mixing_rates


def rates(spark, sizes, targets, total=None):
    s = spark.createDataFrame(sizes, "source STRING, tokens BIGINT")
    t = spark.createDataFrame(targets, "source STRING, weight DOUBLE, max_repeats INT")
    return {r.source: r.rate for r in mixing_rates(s, t, None if total is None else F.lit(total)).collect()}


def test_rates(spark):
    got = rates(spark, [("a", 1000), ("b", 100), ("z", 5)], [("a", 1.0, 4), ("b", 1.0, 2), ("none", 3.0, 2), ("z", 0.0, 3), ("z", 0.0, 3), (None, 1.0, 1), ("a", 1.0, 4)], 600)
    assert got == {"a": pytest.approx(0.4), "b": 2.0, "none": 0.0, "z": 0.0}
    assert rates(spark, [("a", 1000), ("b", 1000)], [("a", 3.0, 1), ("b", 1.0, 1)])["b"] == pytest.approx(1 / 3)
    assert rates(spark, [("a", 10)], [("a", 1.0, 2)], 100) == {"a": 2.0}
    assert rates(spark, [], []) == {}


def test_mix(spark):
    docs = [(i, "one two three four " * (1 + i % 3), "a" if i % 10 else "b", 1) for i in range(1500)] + [(9000, None, "a", 1), (9001, "lone", None, 1), (9002, "other", "c", 1)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, copies INT")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 4), ("gone", 1.0, 2)], "source STRING, weight DOUBLE, max_repeats INT")
    mix = Mix(df, targets)
    records = mix.records().collect()
    report = {r.source: r for r in mix.report().collect()}
    assert {r.source for r in records} == {"a", "b"} and max(r.copy_no for r in records if r.source == "a") == 1 and max(r.copy_no for r in records) <= 4
    assert sum(r.tokens for r in records) == sum(r.mixed_tokens for r in report.values())
    assert report["gone"].reached_share == 0 and abs(report["a"].reached_share - 0.5) < 0.06 and abs(report["b"].reached_share - 0.5) < 0.06
    assert sorted((r.doc_id, r.copy_no) for r in records) == sorted((r.doc_id, r.copy_no) for r in Mix(df.repartition(7), targets).records().collect())
    assert Mix(df.limit(0), targets).records().collect() == []


def test_copies_keep_the_rate(spark):
    n = spark.range(20_000).select(copies_of(F.col("id"), F.lit(1.25)).alias("c")).agg(F.sum("c")).first()[0]
    assert abs(n / 20_000 - 1.25) < 0.02
