import random

import pytest
from pyspark.sql import functions as F

from quern.operators import discovery


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("rare, wide", [(32, 10), (2, 10), (0, 10), (0, 3), (2, 2)])
def test_first_similar_against_brute_force(spark, rare, wide):
    rng = random.Random(rare * 100 + wide)
    sets = set()
    while len(sets) < 300:
        sets.add(frozenset(rng.sample([f"w{k}" for k in range(14)], rng.randint(1, 9)) + [f"name{rng.randrange(60)}" for _ in range(rng.randrange(3))]))
    rows = list(enumerate(sorted(map(sorted, sets), key=lambda _: rng.random())))
    classes = spark.createDataFrame(rows, "cls BIGINT, words ARRAY<STRING>").repartition(3)
    got = {r.a: r.near for r in discovery.first_similar(classes, 0.6, rare, wide).collect()}
    alike = lambda x, y: len(set(x) & set(y)) * 5 >= 3 * len(set(x) | set(y))
    want = {b: min(before) for b, y in rows if (before := [a for a, x in rows[:b] if alike(x, y)])}
    assert got == want and len(want) > 40


def test_titles_of_one_phrase_are_no_pairs(spark):
    """The words of a phrase that 3,000 titles share make 4.5 million pairs, which were all shuffled."""
    df = spark.range(3000).select(F.col("id").alias("ord"), F.format_string("first%d last%d see gains in solar power", "id", "id").alias("title"))
    before = shuffled(spark)
    got = discovery.title_clusters(df)
    assert got.where("ord = cluster").count() == 3000
    assert shuffled(spark) - before < 3e6
