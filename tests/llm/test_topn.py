import math
import random

import pytest

from quern.llm.topn import top_n_per_group

SCHEMA = "cluster STRING, priority DOUBLE, ord BIGINT, g STRING, score STRING"


def brute(rows, n):
    groups = {}
    for c, p, o, *_ in rows:
        if c is not None and p is not None and o is not None and not math.isnan(p):
            groups.setdefault(c, []).append((-(p + 0.0), o))
    return sorted((c, o, i + 1) for c, x in groups.items() for i, (_, o) in enumerate(sorted(x)[:n]))


def run(spark, rows, n, **more):
    return sorted(tuple(r) for r in top_n_per_group(spark.createDataFrame(rows, SCHEMA), "cluster", "priority", "ord", n, **more).collect())


@pytest.mark.parametrize("n", [1, 3, 50])
def test_against_brute_force(spark, n):
    rng = random.Random(n)
    values = [0.0, -0.0, 1.5, -2.5, 3.25, 1e300, -1e-300, math.inf, -math.inf, math.nan, None, 7.0, 7.000000000000001]
    rows = [(rng.choice(["a", "b", "c", None, "d"]), rng.choice(values), i, "x", "y") for i in range(400)]
    rows += [("hot", float(i % 3), i, None, None) for i in range(1000, 3000)]
    assert run(spark, rows, n) == brute(rows, n)


def test_many_ties_and_negative_identifiers(spark):
    rows = [("a", 5.0, i, "", "") for i in range(-500, 500)] + [("a", 6.0, 999_999_999_999, "", "")]
    assert run(spark, rows, 4, fanout=2) == [("a", -500, 2), ("a", -499, 3), ("a", -498, 4), ("a", 999_999_999_999, 1)]


def test_repeated_rows_count_each_time(spark):
    rows = [("a", 1.0, 7, "", "")] * 10 + [("b", 1.0, 8, "", "")] * 2
    assert run(spark, rows, 3) == [("a", 7, 1), ("a", 7, 2), ("a", 7, 3), ("b", 8, 1), ("b", 8, 2)]


def test_empty(spark):
    assert run(spark, [], 3) == [] and run(spark, [(None, None, None, None, None)], 3) == []
    with pytest.raises(ValueError):
        run(spark, [], 0)
