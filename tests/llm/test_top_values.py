import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagloom.llm import top_values as module
from tagloom.llm.top_values import top_values


def brute(values, k, share):
    counts = Counter(v for v in values if v is not None)
    total = sum(counts.values())
    least = 1
    if share is not None:
        least = max(least, share * total)
    if k is not None and len(counts) > k:
        least = max(least, sorted(counts.values(), reverse=True)[k - 1])
    return {v: n for v, n in counts.items() if n >= least}


def skewed(seed):
    r = random.Random(seed)
    return [r.choice([5, 5, 5, -9, None, r.getrandbits(63), r.randrange(30)]) for _ in range(6_000)]


@pytest.mark.parametrize("k, share", [(1, None), (10, None), (100, None), (10_000, None), (None, Fraction(1, 500)), (None, 0.1), (5, Fraction(1, 100))])
def test_equals_counting(spark, k, share):
    values = skewed(k or 0)
    df = spark.createDataFrame([(v,) for v in values], "x bigint").withColumn("__v", F.lit(1)).withColumn("n", F.lit(1)).repartition(4)
    got = top_values(df, "x", k, share).collect()
    assert {r["value"]: r["n"] for r in got} == brute(values, k, share)


def test_ties_beyond_the_list(spark, monkeypatch):
    """More tied prefixes than are kept as a list: rounds without a list give the same."""
    monkeypatch.setattr(module, "RETAINED", 20)
    values = list(range(3_000)) + [1, 2, 2]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert {r["value"]: r["n"] for r in top_values(df, "x", 5).collect()} == brute(values, 5, None)
    assert {r["value"]: r["n"] for r in top_values(df, "x", 2).collect()} == {1: 2, 2: 3}


def test_prefixes_that_collide_are_lengthened(spark, monkeypatch):
    monkeypatch.setattr(module, "PREFIX_BITS", (1, 2, 64))
    values = skewed(7)
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert {r["value"]: r["n"] for r in top_values(df, "x", 7).collect()} == brute(values, 7, None)


def test_strings_and_nothing(spark):
    df = spark.createDataFrame([(v,) for v in ["a"] * 3 + ["b"] + [None] * 9], "x string")
    assert [tuple(r) for r in top_values(df, "x", 1).collect()] == [("a", 3)]
    assert top_values(df.where("x is null"), "x", 3).collect() == []
    assert top_values(df.limit(0), "x", share=0.5).collect() == []
    with pytest.raises(ValueError):
        top_values(df, "x")
