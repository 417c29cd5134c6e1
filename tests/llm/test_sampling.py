import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import sampling
from tagloom.llm.sampling import accept_waitlist_sample, bounds


def kinds():
    return F.array_compact(F.array(F.lit("all"), F.when(F.col("id") % 3 == 0, "third")))


def key(seed, *parts):
    return hashlib.md5(":".join(["%d" % seed, *map(str, parts)]).encode()).hexdigest()


def sample(df, size, n, seed=0, scopes=None):
    sizes = {"all": n} if scopes is not None else {"all": n, "third": len(range(0, n, 3))}
    return accept_waitlist_sample(df, ["id"], size, sizes, kinds() if scopes is None else scopes, seed)


@pytest.mark.parametrize("size", [0, 1, 100, 2_999, 3_000, 50_000])
def test_is_the_least_keys(spark, size):
    n = 3_000
    df = spark.range(n).union(spark.range(500)).withColumn("scope", F.lit("clash")).repartition(5)
    got = sample(df.drop("scope"), size, n).collect()
    for scope, ids in (("all", range(n)), ("third", range(0, n, 3))):
        expected = sorted(ids, key=lambda i: key(0, i))[:size]
        assert Counter(r["id"] for r in got if r["scope"] == scope) == Counter(expected)


def test_failed_bounds_are_widened(spark, monkeypatch):
    """Bounds that always fail at first: too few below the second, or too many below the first."""
    for wrong in ((0.0, 0.01), (0.9, 0.95)):
        real, calls = bounds, []

        def broken(n, size, risk):
            calls.append(risk)
            return wrong if risk == sampling.RISK else real(n, size, risk)

        monkeypatch.setattr(sampling, "bounds", broken)
        got = [r["id"] for r in sample(spark.range(2_000), 500, 2_000).where("scope = 'all'").collect()]
        assert sorted(got) == sorted(sorted(range(2_000), key=lambda i: key(0, i))[:500])
        assert len(set(calls)) > 1
        monkeypatch.setattr(sampling, "bounds", real)


def test_every_record_is_as_likely(spark):
    n, size, rounds = 200, 50, 40
    hits = Counter()
    for seed in range(rounds):
        hits.update(r["id"] for r in sample(spark.range(n), size, n, seed, F.array(F.lit("all"))).collect())
    assert sum(hits.values()) == size * rounds
    expected = size * rounds / n
    chi2 = sum((hits[i] - expected) ** 2 / (expected * (1 - size / n)) for i in range(n))
    assert chi2 < 280  # 199 degrees of freedom: 1 in 10,000


def test_bounds_hold_and_are_narrow():
    for n, size in ((10**6, 10**4), (10**9, 10**5), (1_000, 999)):
        low, high = bounds(n, size, 1e-4)
        assert 0 <= low < size / n < high <= 1
        assert (high - low) * n < 20 * size**0.5 + 100
    assert bounds(5, 5, 1e-4) == (1.0, 1.0)


def test_wrong_sizes_are_an_error(spark):
    with pytest.raises(ValueError):
        accept_waitlist_sample(spark.range(10), ["id"], 50, {"all": 20}, F.array(F.lit("all")))


def test_nothing_and_nulls(spark):
    empty = spark.range(0)
    assert accept_waitlist_sample(empty, ["id"], 5, {"all": 0}, F.array(F.lit("all"))).collect() == []
    df = spark.createDataFrame([(None, 1), (None, 1), (1, None)], "id bigint, other bigint")
    got = accept_waitlist_sample(df, ["id", "other"], 5, {"all": 2}, F.array(F.lit("all")))
    assert got.columns == ["scope", "id", "other"] and got.count() == 2
