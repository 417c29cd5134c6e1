import itertools

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom import errors as E
from tagloom.functions.unsigned import MASK, from_bits, to_bits
from tagloom.header import Header
from tagloom.operators import records as ops
from tagloom.operators.fold import Processor, fold, fold_file, scan_totals
from tagloom.sources.binary import read_records, write_records
from tagloom.sources.generators import patterned_records

EDGES = [0, 1, (1 << 63) - 1, 1 << 63, MASK]
ALL = list(itertools.product(EDGES, repeat=3))


def frame(spark, triples, parts=3):
    rows = [tuple(map(to_bits, t)) for t in triples]
    return spark.createDataFrame(rows, "barcode bigint, umi bigint, index bigint").repartition(parts)


def plain(rows):
    return [tuple(from_bits(r[f]) for f in ops.FIELDS) for r in rows]


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_partitioning_changes_nothing(spark, parts):
    df = frame(spark, ALL + ALL[:10], parts)
    assert plain(ops.sort_records(df).collect()) == sorted(ALL + ALL[:10])
    assert plain(ops.extreme_records(df).orderBy(F.desc("which")).collect()) == [(0, 0, 0), (MASK,) * 3]
    assert sorted(plain(ops.distinct_triples(df).collect())) == ALL
    assert ops.record_count(df).first()[0] == 135
    sums = [sum(t[i] for t in ALL + ALL[:10]) for i in range(3)]
    assert [int(x) for x in ops.field_sums(df).first()] == [*sums, sum(sums)]
    assert [from_bits(x) for x in ops.field_sums(df, wrapping=True).first()] == [x & MASK for x in [*sums, sum(sums)]]
    xor = 0
    for t in ALL + ALL[:10]:
        xor ^= t[0] ^ t[1] ^ t[2]
    assert from_bits(ops.xor_checksum(df).first()[0]) == xor


def test_empty(spark):
    df = frame(spark, [])
    assert ops.record_count(df).first()[0] == 0 == ops.xor_checksum(df).first()[0] == int(ops.index_sum(df).first()[0])
    assert [int(x) for x in ops.field_sums(df).first()] == [0] * 4
    assert ops.extreme_records(df).collect() == ops.barcode_counts(df).collect() == ops.ranked(df).collect() == []
    assert ops.verify_sorted(df)
    with pytest.raises(E.InvalidIndex):
        ops.slice_sorted(df, 0, 1)


def test_positions_and_slice(spark):
    df = frame(spark, ALL * 3, 5)
    placed = sorted((r["position"], plain([r])[0]) for r in ops.ranked(df).collect())
    assert placed == list(enumerate(sorted(ALL * 3)))
    part = ops.slice_sorted(df, 100, 130).orderBy("position")
    assert plain(part.collect()) == sorted(ALL * 3)[100:130]
    for bounds in ((375, 376), (0, 376), (5, 5), (6, 5), (-1, 2)):
        with pytest.raises(E.InvalidIndex):
            ops.slice_sorted(df, *bounds)


def test_position_column_may_be_there(spark):
    df = frame(spark, ALL).withColumn("__id", F.lit(1)).withColumn("k0", F.lit("x"))
    out = ops.with_positions(df, [F.col("barcode")])
    assert out.columns == [*df.columns, "position"] and out.count() == 125


def test_verify_sorted(spark):
    df = frame(spark, ALL * 20, 4)
    assert ops.verify_sorted(ops.sort_records(df))
    assert not ops.verify_sorted(df.orderBy("barcode", "umi", "index"))
    assert not ops.verify_sorted(ops.sort_records(df).coalesce(1).orderBy(F.desc("barcode")))


def test_counts_sums_and_concat(spark):
    df = frame(spark, [(1, 2, 3), (1, 0, MASK), (2, 0, 1)])
    assert {r[0]: r[1] for r in ops.barcode_counts(df).collect()} == {1: 2, 2: 1}
    assert int(ops.index_sum(df).first()[0]) == MASK + 4
    assert ops.concatenated(df, df.withColumn("more", F.lit(1))).count() == 6


def test_hex_and_json(spark):
    df = frame(spark, [(0xC3A9, 1 << 63, MASK)])
    row = ops.record_hex(df).first()
    assert row["hex"] == "A9C3000000000000" + "0000000000000080" + "F" * 16
    assert ops.to_json(df).first()[0] == f'{{"barcode":{0xC3A9},"umi":{1 << 63},"index":{MASK}}}'
    assert plain(ops.from_json(ops.to_json(df)).collect()) == [(0xC3A9, 1 << 63, MASK)]


def test_partition_plan(spark):
    plan = spark.range(1).select(F.explode(ops.partition_plan(F.lit(10).cast("bigint"), 4)).alias("p")).select("p.*")
    assert [tuple(r) for r in plan.collect()] == [(0, 0, 2), (1, 2, 4), (2, 4, 6), (3, 6, 10)]


def test_aggregates_stay_in_the_engine(spark, tmp_path):
    path = str(tmp_path / "r")
    write_records(frame(spark, ALL), path, Header(16, 12))
    df = read_records(spark, path)
    for out in (ops.record_count(df), ops.field_sums(df), ops.index_sum(df), ops.barcode_counts(df), ops.xor_checksum(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PythonUDF" not in plan and "MapInArrow" not in plan and "HashAggregate" in plan


class Totals(Processor):
    def init(self, partition):
        return [0, 0, 0]

    def process_batch(self, state, batch):
        return [state[0] + batch.num_rows, state[1] + sum(batch.column("index").to_pylist()), state[2]]

    def on_batch_complete(self, state):
        return [state[0], state[1], state[2] + 1]

    def merge(self, left, right):
        return [a + b for a, b in zip(left, right)]

    def finish(self, state):
        return tuple(state)


class Order(Processor):
    """Keeps what it sees in order, so that merging out of order would show."""

    def init(self, partition):
        return []

    def process_batch(self, state, batch):
        return state + batch.column("index").to_pylist()

    def merge(self, left, right):
        return left + right


class Fails(Totals):
    def process_batch(self, state, batch):
        if 5 in batch.column("index").to_pylist():
            raise ValueError("five")
        return super().process_batch(state, batch)


# What runs in workers is sent by value, as this module isn't on their path.
from pyspark import cloudpickle  # noqa: E402
import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("parts", [0, 1, 3, 40])
def test_fold(spark, parts):
    df = patterned_records(spark, 10_000)
    n, total, batches = fold(df, Totals(), parts)
    assert (n, total) == (10_000, 49_995_000) and batches >= 1


def test_fold_keeps_order_and_handles_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    write_records(patterned_records(spark, 2_000), path, Header(16, 12))
    assert fold(read_records(spark, path, partitions=50), Order()) == list(range(2_000))
    assert fold(frame(spark, []), Totals()) == (0, 0, 0)
    assert fold(frame(spark, [(3, 3, 3)], 7), Totals())[0] == 1


@pytest.mark.parametrize("parts", [0, 1, 3, 40])
def test_fold_of_a_file(spark, tmp_path, parts):
    path = str(tmp_path / "r")
    write_records(patterned_records(spark, 2_000), path, Header(16, 12))
    assert fold_file(spark, path, Order(), parts) == list(range(2_000))
    write_records(frame(spark, []), path, Header(16, 12))
    assert fold_file(spark, path, Totals(), parts) == (0, 0, 0)


@pytest.mark.parametrize("parts", [0, 1, 7])
def test_scan_totals(spark, tmp_path, parts):
    path = str(tmp_path / "r")
    rows = ALL * 3 + [(MASK, MASK, MASK)] * 50
    write_records(frame(spark, rows), path, Header(16, 12))
    n, *sums, checksum = scan_totals(spark, path, parts).first()
    assert n == len(rows) and [int(x) for x in sums] == [sum(r[i] for r in rows) for i in range(3)]
    assert checksum == ops.xor_checksum(read_records(spark, path)).first()[0]
    write_records(frame(spark, []), path, Header(16, 12))
    assert [int(x) for x in scan_totals(spark, path, parts).first()] == [0] * 5


def test_fold_error(spark, tmp_path):
    with pytest.raises(E.ProcessError, match="five") as e:
        fold(frame(spark, [(i, i, i) for i in (3, 4, 5)]), Fails())
    assert e.value.__cause__ is not None
    write_records(frame(spark, [(i, i, i) for i in (3, 4, 5)]), str(tmp_path / "r"), Header(16, 12))
    with pytest.raises(E.ProcessError, match="five"):
        fold_file(spark, str(tmp_path / "r"), Fails())


def test_large_partition_has_several_batches(spark, tmp_path):
    path = str(tmp_path / "big")
    write_records(patterned_records(spark, 1_200_000), path, Header(16, 12))
    n, total, batches = fold(read_records(spark, path, partitions=1), Totals())
    assert n == 1_200_000 and total == n * (n - 1) // 2 and batches > 1
    assert isinstance(pa.int64(), pa.DataType)
