import pytest
from pyspark.sql import functions as F

from tagloom.functions.sequence import decode_bases, encode_bases
from tagloom.functions.unsigned import MASK, from_bits, lit_u64, record_less, to_bits, u64, u64_sum, ukey
from tagloom.sources.codec import decode, encode

EDGES = [0, 1, (1 << 63) - 1, 1 << 63, MASK]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(to_bits(x),) for x in EDGES[::-1]], "x bigint")


def test_bits():
    assert [from_bits(to_bits(x)) for x in EDGES] == EDGES
    for bad in (-1, 1 << 64):
        with pytest.raises(ValueError):
            to_bits(bad)


def test_order_and_decimal(edges):
    assert [int(r[0]) for r in edges.orderBy(ukey("x")).select(u64("x")).collect()] == EDGES
    assert edges.select(u64("x").alias("u")).dtypes == [("u", "decimal(20,0)")]
    assert edges.select(ukey(ukey("x"))).collect() == edges.collect()


def test_sums(edges):
    exact, wrapped = edges.agg(u64_sum("x"), u64_sum("x", wrapping=True)).first()
    assert int(exact) == sum(EDGES)
    assert from_bits(wrapped) == sum(EDGES) & MASK


def test_sum_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(None,), (5,)], "x bigint")
    assert int(df.agg(u64_sum("x")).first()[0]) == 5
    assert df.where("x is null").agg(u64_sum("x"), u64_sum("x", True)).first()[:] == (None, None)
    assert u64 is not None and df.select(u64("x")).collect()[0][0] is None


def test_literals(edges):
    assert edges.where(F.col("x") == lit_u64(1 << 63)).count() == 1


def test_record_order(spark):
    triples = [(a, b, c) for a in (0, 1 << 63) for b in (0, MASK) for c in (0, 1)]
    pairs = [(*map(to_bits, a), *map(to_bits, b), a < b) for a in triples for b in triples]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, c bigint, d bigint, e bigint, f bigint, less boolean")
    got = df.select(record_less([F.col(c) for c in "abc"], [F.col(c) for c in "def"]), "less").collect()
    assert all(r[0] == r[1] for r in got)


def test_codec_roundtrip():
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    word = st.integers(0, MASK)

    @settings(deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(word, word, word), max_size=50))
    def roundtrip(triples):
        assert decode(encode(triples)) == triples

    roundtrip()
    assert encode([(1, 2, 3)]).hex() == "0100000000000000" + "0200000000000000" + "0300000000000000"
    with pytest.raises(ValueError):
        decode(bytes(23))


@pytest.mark.parametrize("first", ["low", "high"])
def test_bases(spark, first):
    texts = ["", "A", "ACGT", "T" * 32, "GATTACA", "C" * 31 + "T", "ACGN", "acgt", "A" * 33, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    coded = df.select("t", encode_bases(F.col("t"), first).alias("x"))
    bits = {r["t"]: r["x"] for r in coded.collect()}
    assert bits["ACGN"] is bits["acgt"] is bits["A" * 33] is bits[None] is None
    assert bits["ACGT"] == (0b11100100 if first == "low" else 0b00011011)
    assert from_bits(bits["T" * 32]) == MASK
    back = coded.where("x is not null").select("t", decode_bases(F.col("x"), F.length("t"), first).alias("b"))
    assert all(r["t"] == r["b"] for r in back.collect())
    with pytest.raises(ValueError):
        encode_bases(F.col("t"), "middle")


def test_totals_of_records():
    import random

    import numpy as np

    from tagloom.sources.codec import LAYOUT, totals

    r = random.Random(1)
    for n in (0, 1, 255, 256, 257, 33_000, 70_001):
        rows = [(r.choice([MASK, 0, r.getrandbits(64)]), MASK, r.getrandbits(64)) for _ in range(n)]
        low, high, mixed = totals(np.array(rows, LAYOUT) if rows else np.empty(0, LAYOUT))
        assert [a + (b << 32) for a, b in zip(low, high)] == [sum(x[i] for x in rows) for i in range(3)]
        expected = 0
        for x in rows:
            expected ^= x[0] ^ x[1] ^ x[2]
        assert mixed == expected
