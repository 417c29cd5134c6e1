"""Folds over records with a processor of one's own, in parallel by partition.

For what built-in aggregates can express, use those: they stay in generated code. A fold is for state that they can't hold.
"""

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.errors import record_error
from tagloom.functions.unsigned import to_bits
from tagloom.session import written
from tagloom.sources.binary import plan, raw_part, read_part
from tagloom.sources.codec import FIELDS
from tagloom.sources.codec import totals as part_totals

#: States that one task merges.
FAN_IN = 16


class Processor:
    """What a fold does. A task may be repeated, so nothing but the state may change before ``merge``."""

    def init(self, partition: int) -> Any:
        """A partition's first state."""
        raise NotImplementedError

    def process_batch(self, state: Any, batch: pa.RecordBatch) -> Any:
        """The state after a batch of records, which come in file order within a partition."""
        raise NotImplementedError

    def on_batch_complete(self, state: Any) -> Any:
        """The state after a batch has ended; never called for an empty partition."""
        return state

    def merge(self, left: Any, right: Any) -> Any:
        """One state of two, the left one of earlier partitions."""
        raise NotImplementedError

    def finish(self, state: Any) -> Any:
        """The result of the last state."""
        return state


def fold(df: DataFrame, processor: Processor, partitions: int = 0) -> Any:
    """The processor's result over all rows; 0 partitions are as many as the data has, more than it has are as many, too.

    States are written and merged in partition order, ``FAN_IN`` at a time, until one is left for the driver. If the processor
    fails, no result comes out, and its error is the cause of a ``ProcessError``; an error of a record file comes out as such.
    """
    df = df.coalesce(partitions) if partitions else df

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _state(processor, TaskContext.get().partitionId(), batches)

    return _merge(df.mapInArrow(partial, _STATES), processor)


def fold_file(spark: SparkSession, path: str, processor: Processor, partitions: int = 0, access: str = "mmap") -> Any:
    """``fold`` over the records of a file that tasks read by themselves: no record passes through the engine, which makes it the
    fastest way over a file. 0 partitions are one for each core, or more, so that none is larger than one of ``read_records``."""
    parts, options = _parts(spark, path, partitions, access)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from _state(processor, i, read_part(parts[i], options))

    tasks = spark.range(0, len(parts), 1, max(1, len(parts)))
    return _merge(tasks.mapInArrow(partial, _STATES), processor)


def _parts(spark: SparkSession, path: str, partitions: int, access: str) -> tuple[list, dict]:
    options = {"access": access}
    parts = plan(path, options)
    cores = spark.sparkContext.defaultParallelism
    if partitions or len(parts) < cores:
        options["numpartitions"] = str(partitions or cores)
        parts = plan(path, options)
    return parts, options


#: What partial states are sent as.
_STATES = "place bigint, state binary"


def _state(processor: Processor, place: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, any_ = processor.init(place), False
    for b in batches:
        if b.num_rows:
            state, any_ = processor.on_batch_complete(processor.process_batch(state, b)), True
    if any_:
        yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "state": [cloudpickle.dumps(state)]})


def _merge(states: DataFrame, processor: Processor) -> Any:
    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        state = None
        for i, raw in enumerate(table.sort_by("place")["state"].to_pylist()):
            state = cloudpickle.loads(raw) if i == 0 else processor.merge(state, cloudpickle.loads(raw))
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "state": [cloudpickle.dumps(state)]})

    try:
        states = written(states)
        last = states.agg(F.max("place")).first()[0]
        while last:
            last //= FAN_IN
            states = states.groupBy(F.floor(F.col("place") / FAN_IN).alias("g")).applyInArrow(lambda key, table: merged(key, table), _STATES)
        found = states.collect()
    except Exception as e:
        raise record_error(e) from e
    assert len(found) <= 1, "states with equal places"
    return processor.finish(cloudpickle.loads(found[0]["state"]) if found else processor.init(0))


def fold_columns(df: DataFrame, function, schema: str, merge: dict[str, str]) -> DataFrame:
    """A fold as a DataFrame: ``function`` turns a partition's batches into rows of ``schema``, whose columns are merged by the
    aggregate functions named in ``merge``. An action on it brings an error in Spark's wrapping; see ``typed_errors``."""
    return df.mapInArrow(function, schema).agg(*(F.expr(f"{how}({c})").alias(c) for c, how in merge.items()))


def scan_totals(spark: SparkSession, path: str, partitions: int = 0, access: str = "mmap") -> DataFrame:
    """``n_records, barcode_sum, umi_sum, index_sum, checksum`` of a file in one pass by tasks that read it themselves.

    Sums are exact and unsigned, as DECIMAL(38,0), summed in 32-bit halves; the checksum is the XOR of all fields, as bits.
    """
    parts, options = _parts(spark, path, partitions, access)
    halves = [f"{f}_{h}" for f in FIELDS for h in ("low", "high")]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                n, sums, mixed = 0, [0] * 6, 0
                for raw in raw_part(parts[i], options):
                    n += len(raw)
                    low, high, x = part_totals(raw)
                    sums = [a + b for a, b in zip(sums, (low[0], high[0], low[1], high[1], low[2], high[2]))]
                    mixed ^= x
                row = {"n_records": n, **dict(zip(halves, sums)), "checksum": to_bits(mixed)}
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in row.items()})

    schema = ", ".join(f"{c} bigint" for c in ("n_records", *halves, "checksum"))
    found = spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(totals, schema)
    wide = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0)).cast("decimal(28,0)")
    return found.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).cast("bigint").alias("n_records"),
        *((wide(f"{f}_low") + wide(f"{f}_high") * F.expr("4294967296BD")).cast("decimal(38,0)").alias(f"{f}_sum") for f in FIELDS),
        F.coalesce(F.bit_xor("checksum"), F.lit(0).cast("bigint")).alias("checksum"),
    )
