"""Counting, summing, ordering and slicing records. All of it is planned by Catalyst; nothing passes through Python
except the check of the order, which needs the rows in their place."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.unsigned import record_keys, u64, u64_sum, ukey, wrap
from tagloom.session import written
from tagloom.sources.binary import check_range

FIELDS = ("barcode", "umi", "index")
#: Records up to which a slice from the start is taken as the least ones; the result is the same either way.
FEW = 1_000_000


def record_count(df: DataFrame) -> DataFrame:
    """``n_records``."""
    return df.agg(F.count(F.lit(1)).alias("n_records"))


def field_sums(df: DataFrame, wrapping: bool = False) -> DataFrame:
    """``barcode_sum, umi_sum, index_sum, total_sum``: unsigned sums, exact, or modulo 2^64 as bits; 0 without records."""
    sums = df.agg(*(F.coalesce(u64_sum(f), F.lit(0).cast("decimal(38,0)")).alias(f"{f}_sum") for f in FIELDS))
    total = (F.col("barcode_sum") + F.col("umi_sum") + F.col("index_sum")).cast("decimal(38,0)")
    sums = sums.withColumn("total_sum", total)
    return sums.select(*(wrap(F.col(c)).alias(c) for c in sums.columns)) if wrapping else sums


def index_sum(df: DataFrame) -> DataFrame:
    """``index_sum``: the unsigned sum of ``index``."""
    return df.agg(F.coalesce(u64_sum("index"), F.lit(0).cast("decimal(38,0)")).alias("index_sum"))


def xor_checksum(df: DataFrame) -> DataFrame:
    """``checksum``: XOR of all fields of all records; independent of their order, 0 without records."""
    mixed = F.col("barcode").bitwiseXOR(F.col("umi")).bitwiseXOR(F.col("index"))
    return df.agg(F.coalesce(F.bit_xor(mixed), F.lit(0).cast("bigint")).alias("checksum"))


def barcode_counts(df: DataFrame) -> DataFrame:
    """``barcode, n_records``; counted before and after the shuffle, so that frequent barcodes don't crowd a task."""
    return df.groupBy("barcode").agg(F.count(F.lit(1)).alias("n_records"))


def sort_records(df: DataFrame) -> DataFrame:
    """The records in unsigned lexicographic order."""
    return df.orderBy(*record_keys())


def distinct_triples(df: DataFrame) -> DataFrame:
    """Records that differ in any bit, once each."""
    return df.select(*FIELDS).distinct()


def extreme_records(df: DataFrame) -> DataFrame:
    """``which, barcode, umi, index``: the first and the last record in unsigned order; no rows without records."""
    keys = F.struct(*(ukey(f).alias(f) for f in FIELDS))
    ends = df.agg(F.min(keys).alias("min"), F.max(keys).alias("max"))
    both = F.explode(F.array(*(F.struct(F.lit(w).alias("which"), F.col(w).alias("r")) for w in ("min", "max"))))
    out = ends.select(both.alias("e")).where("e.r is not null")
    return out.select("e.which", *(ukey(F.col(f"e.r.{f}")).alias(f) for f in FIELDS))


def with_positions(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` with ``position``, from 0, in the order of ``keys``, without bringing the rows into one task.

    Rows are sorted over all partitions and written; positions are those within a partition plus the sizes of the partitions before.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    ordered = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    ordered = ordered.orderBy(*(f"k{i}" for i in range(len(keys)))).drop(*(f"k{i}" for i in range(len(keys))))
    placed = written(ordered.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one number a partition
    skipped, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, skipped))
        skipped += sizes[p]
    if not offsets:
        offsets = [(0, 0)]
    before = df.sparkSession.createDataFrame(offsets, "__p bigint, __skip bigint")
    out = placed.withColumn("__p", part).join(F.broadcast(before), "__p")
    position = (F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__skip")).alias("position")
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), position)


def slice_sorted(df: DataFrame, start: int, end: int) -> DataFrame:
    """Records ``start`` to ``end``, exclusive, in unsigned order, with ``position``; bad bounds raise ``InvalidIndex``.

    Up to ``FEW`` as ``end`` only so many first records are kept of each task; beyond, all records are sorted. For a range of
    a file in its own order use ``read_records(start=, end=)``, which reads no other records.
    """
    check_range(start, end, df.count())
    if end <= FEW:
        return with_positions(top_records(df, end), record_keys()).where(F.col("position") >= start)
    return with_positions(df.select(*FIELDS), record_keys()).where(F.col("position").between(start, end - 1))


def top_records(df: DataFrame, n: int, largest: bool = False) -> DataFrame:
    """The first ``n`` records in unsigned order, or the last; every task hands on no more than ``n``."""
    keys = [k.desc() for k in record_keys()] if largest else record_keys()
    return df.select(*FIELDS).orderBy(*keys).limit(n)


def ranked(df: DataFrame) -> DataFrame:
    """All records with ``position`` in unsigned order."""
    return with_positions(df.select(*FIELDS), record_keys())


def concatenated(*parts: DataFrame) -> DataFrame:
    """The records of all parts, as often as they are there."""
    out = parts[0].select(*FIELDS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FIELDS))
    return out


def _order_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = last = None
    good = True
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
        rows = keys if last is None else np.vstack([last, keys])
        step = np.zeros(len(rows) - 1, bool)
        tied = np.ones(len(rows) - 1, bool)
        for i in range(3):
            step |= tied & (rows[1:, i] < rows[:-1, i])
            tied &= rows[1:, i] == rows[:-1, i]
        good = good and not step.any()
        first = keys[0] if first is None else first
        last = keys[-1]
    if first is not None:
        yield pa.RecordBatch.from_pydict(
            {"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "good": [good], "first": [first.tolist()], "last": [last.tolist()]}
        )


def verify_sorted(df: DataFrame) -> bool:
    """Whether the rows, in the order in which a file or a sort gives them, are in unsigned order; a header's claim is not asked.

    Every partition is checked by itself; the driver gets its first and last record.
    """
    keys = df.select(*(k.alias(f"k{i}") for i, k in enumerate(record_keys())))
    parts = sorted(keys.mapInArrow(_order_of, "p int, good boolean, first array<bigint>, last array<bigint>").collect())
    return all(r["good"] for r in parts) and all(a["last"] <= b["first"] for a, b in zip(parts, parts[1:]))


def record_hex(df: DataFrame) -> DataFrame:
    """The records with ``hex``: the bytes of the format, in hexadecimal."""

    def little(f: str) -> Column:
        digits = F.lpad(F.hex(f), 16, "0")
        return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(8)))

    return df.withColumn("hex", F.concat(*(little(f) for f in FIELDS)))


def to_json(df: DataFrame) -> DataFrame:
    """``json``: each record as an object of unsigned numbers."""
    return df.select(F.to_json(F.struct(*(u64(f).alias(f) for f in FIELDS))).alias("json"))


def from_json(df: DataFrame, column: str = "json") -> DataFrame:
    """The records of a column of such objects, as bits."""
    parsed = F.from_json(F.col(column), ", ".join(f"`{f}` decimal(20,0)" for f in FIELDS))
    return df.select(parsed.alias("r")).select(*(wrap(F.col(f"r.{f}").cast("decimal(38,0)")).alias(f) for f in FIELDS))


def partition_plan(n_records: Column, parts: int) -> Column:
    """Array of (part, first, end) that splits so many records evenly, the last part taking the rest."""
    size = F.floor(n_records / parts)
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(
            i.alias("part"),
            (i * size).alias("first_record"),
            F.when(i == parts - 1, n_records).otherwise((i + 1) * size).alias("end_record"),
        ),
    )
