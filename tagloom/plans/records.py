"""Queries of the operators on record files and their SQL. Records are made from lineitem and go through a file."""

import gzip
import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.errors import InvalidIndex, RecordFileError, record_error, typed_errors
from tagloom.functions.sequence import decode_bases, encode_bases
from tagloom.functions.unsigned import lit_u64, record_keys, record_less, u64, u64_sum
from tagloom.header import Header, header_error
from tagloom.operators import records as ops
from tagloom.operators.fold import Processor, fold, fold_columns, fold_file
from tagloom.operators.fold import scan_totals as scan_file
from tagloom.session import remember, shared_dir, table
from tagloom.sources.binary import append_into, count_records, read_records, write_records
from tagloom.sources.codec import FIELDS, encode, from_batch
from tagloom.sources.files import located, read_header, size_of
from tagloom.sources.generators import patterned_records, random_records
from tagloom.sources.standard import read_optional, write_optional
from tagloom.streaming.append import running_barcode_counts, stream_records

_HEADER = Header(16, 12)
#: Records of the patterned query, and of the slice.
_PATTERN, _SLICE = 100_000, (100, 200)


def _path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}.records"
    remember(spark, path)
    return path


def lineitem_records(spark: SparkSession, sf_dir: str, high: bool = False) -> DataFrame:
    """Records of lineitem; with ``high`` odd order keys have the top bit set."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    if high:
        key = F.when(key % 2 == 1, key.bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))).otherwise(key)
    return rows.select(key.alias("barcode"), F.col("l_partkey").alias("umi"), F.col("l_linenumber").cast("bigint").alias("index"))


def _filed(spark: SparkSession, sf_dir: str, high: bool = False, sort: bool = False, **options) -> DataFrame:
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir, high), path, _HEADER, sort=sort)
    return read_records(spark, path, **options)


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, partitions=7)


def bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, access="bulk")


def mmap_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, access="mmap", partitions=3)


def directory_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir).repartition(5), path, _HEADER, layout="directory")
    return read_records(spark, path)


def compressed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file packed by gzip, in two members."""
    return _packed(spark, sf_dir, lambda raw: gzip.compress(raw, 1))


def zstd_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file packed by zstd, in two frames."""
    import zstandard

    return _packed(spark, sf_dir, zstandard.ZstdCompressor().compress)


def _packed(spark: SparkSession, sf_dir: str, pack: Callable[[bytes], bytes]) -> DataFrame:
    path, packed = _path(spark), _path(spark)
    write_records(lineitem_records(spark, sf_dir), path, _HEADER, layout="file")
    fs, inner = located(path)
    other, target = located(packed)
    with fs.open_input_file(inner) as source, other.open_output_stream(target, compression=None) as out:
        while chunk := source.read(size_of(path) // 2 + 1):
            out.write(pack(chunk))
    return read_records(spark, packed).repartition(8)


def stream_barcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per barcode by a stream over a file that has grown."""
    path, counts = _path(spark), _path(spark)
    rows = lineitem_records(spark, sf_dir)
    write_records(rows.where("umi % 2 = 0"), path, _HEADER)
    write_records(rows.where("umi % 2 = 1"), path, _HEADER, mode="append")
    running_barcode_counts(stream_records(spark, path), counts, _path(spark)).awaitTermination()
    return spark.read.parquet(counts)


def random_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is certain of random records: their number and that barcodes and indexes are in range."""
    _, rows = random_records(spark, 10_000, seed=1)
    fits = F.col("barcode").between(0, 999) & F.col("index").between(0, 9_999)
    return rows.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(fits).alias("n_in_range"))


def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each kind of broken file or bad range."""
    good, two = _HEADER.to_bytes(), encode([(1, 2, 3), (4, 5, 6)])
    cases = {
        "zeros": (bytes(32), {}),
        "magic_and_version": (Header(16, 12, magic=1, version=1).to_bytes(), {}),
        "version": (Header(16, 12, version=1).to_bytes(), {}),
        "barcode_length": (Header(33, 0).to_bytes(), {}),
        "umi_length": (Header(16, 0).to_bytes(), {}),
        "empty": (b"", {}),
        "short": (good[:31], {}),
        "cut_sequential": (good + two[:-5], {}),
        "cut_bulk": (good + two[:-5], {"access": "bulk"}),
        "cut_mmap": (good + two[:-5], {"access": "mmap"}),
        "range_beyond": (good + two, {"start": 0, "end": 3}),
        "range_empty": (good + two, {"start": 1, "end": 1}),
        "good": (good + two, {}),
    }
    found = []
    for case, (raw, options) in cases.items():
        path = _put(spark, raw)
        try:
            read_records(spark, path, **options)
            found.append((case, None))
        except RecordFileError as e:
            found.append((case, type(e).__name__))
    return spark.createDataFrame(found, "case string, error string")


def packed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of each kind of broken compressed file, which only a task sees."""
    raw = _HEADER.to_bytes() + encode([(i, 0, i * i) for i in range(20_000)])
    cases = {"cut_record": gzip.compress(raw[:-5], 1), "cut_stream": gzip.compress(raw, 1)[:-300], "good": gzip.compress(raw, 1)}
    found = []
    for case, packed in cases.items():
        path = _put(spark, packed)
        try:
            with typed_errors():
                found.append((case, None, read_records(spark, path).count()))
        except RecordFileError as e:
            found.append((case, type(e).__name__, getattr(e, "pos", None)))
    return spark.createDataFrame(found, "case string, error string, number bigint")


def wrapped_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of other kinds as those of record files."""
    cases = {"value": ValueError("x"), "system": FileNotFoundError("x"), "own": InvalidIndex(2, 1)}
    found = [(case, type(record_error(e)).__name__, record_error(e) is e) for case, e in cases.items()]
    return spark.createDataFrame(found, "case string, error string, same boolean")


def directory_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of files after fifteen appends."""
    rows, path = lineitem_records(spark, sf_dir), _path(spark)
    for i in range(16):
        write_records(rows.where(F.col("barcode") % 16 == i), path, _HEADER, mode="append", layout="directory", sort=i == 0)
    return read_records(spark, path).withColumn("claimed", F.lit(read_header(path).sorted))


def append_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be appended, and the records that are there after it has been refused."""
    rows, found = patterned_records(spark, 100), []
    for there in ("file", "directory"):
        for case, header, layout in (
            ("lengths", Header(20, 12), there), ("other_layout", _HEADER, "file" if there == "directory" else "directory"), ("good", _HEADER, "auto"),
        ):
            path = _path(spark)
            write_records(rows, path, _HEADER, layout=there)
            try:
                write_records(rows, path, header, mode="append", layout=layout)
                error = None
            except RecordFileError as e:
                error = type(e).__name__
            found.append((there, case, error, read_records(spark, path).count()))
    return spark.createDataFrame(found, "there string, case string, error string, n_records bigint")


def written_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a write and an append give."""
    rows, path = lineitem_records(spark, sf_dir), _path(spark)
    first = write_records(rows, path, _HEADER)
    again = write_records(rows.where("umi < 1000"), path, _HEADER, mode="append")
    return spark.createDataFrame([(first, again)], "first_write bigint, append bigint")


def standard_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to a stream as standard output and read from it as standard input."""
    out = io.BytesIO()
    write_optional(lineitem_records(spark, sf_dir), None, _HEADER, stream=out)
    return read_optional(spark, None, stream=io.BytesIO(out.getvalue()))


def header_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different headers among the table's rows, as objects and as rows."""
    heads = table(spark, sf_dir, "headers").select("magic", "version", "bc_len", "umi_len", "flags", "reserved").where("reserved is not null").dropna()
    objects = {Header(r["bc_len"], r["umi_len"], r["flags"], bytes(r["reserved"]), r["magic"], r["version"]) for r in heads.distinct().collect()}
    again = {Header.from_json(h.to_json()) for h in objects}
    return spark.createDataFrame([(len(objects), objects == again)], "n_headers bigint, same_by_json boolean")


def _put(spark: SparkSession, raw: bytes) -> str:
    path = _path(spark)
    fs, inner = located(path)
    with fs.open_output_stream(inner, compression=None) as out:
        out.write(raw)
    return path


def record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.record_count(_filed(spark, sf_dir))


def size_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count by file size alone."""
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir), path, _HEADER)
    return spark.createDataFrame([(count_records(path),)], "n_records bigint")


def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of a sorted file, read back."""
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir), path, _HEADER, sort=True)
    h = read_header(path)
    return spark.createDataFrame([(h.version, h.bc_len, h.umi_len, h.flags, h.sorted)], "version int, bc_len int, umi_len int, flags bigint, sorted boolean")


def field_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = ops.field_sums(_filed(spark, sf_dir))
    return sums.select(*(F.col(c).cast("bigint").alias(c) for c in sums.columns))


def index_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.index_sum(_filed(spark, sf_dir)).select(F.col("index_sum").cast("bigint").alias("index_sum"))


def barcode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.barcode_counts(_filed(spark, sf_dir))


def xor_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.xor_checksum(_filed(spark, sf_dir))


def sorted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(_filed(spark, sf_dir))


def slice_100_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, sort=True, start=_SLICE[0], end=_SLICE[1])


def slice_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.slice_sorted(_filed(spark, sf_dir, high=True), *_SLICE)


def top_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest records, with values of 2^63 and more."""
    return ops.top_records(_filed(spark, sf_dir, high=True), 10, largest=True)


def single_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, sort=True, start=50, end=51)


def verify_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a file in unsigned order, and one in signed order, are sorted."""
    good = ops.verify_sorted(_filed(spark, sf_dir, high=True, sort=True, partitions=5))
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir, True).orderBy("barcode", "umi", "index"), path, _HEADER, claim_sorted=True)
    bad = ops.verify_sorted(read_records(spark, path, partitions=5))
    return spark.createDataFrame([(good, bad)], "unsigned_order boolean, signed_order boolean")


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_triples(_filed(spark, sf_dir))


def min_max_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extreme_records(_filed(spark, sf_dir))


def hi_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.extreme_records(_filed(spark, sf_dir, high=True))


def record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records before and not before a fixed one."""
    bound = [lit_u64((1 << 63) + 5), lit_u64(100), lit_u64(3)]
    rows = _filed(spark, sf_dir, high=True)
    return rows.groupBy(record_less([F.col(c) for c in ops.FIELDS], bound).alias("before")).agg(F.count(F.lit(1)).alias("n_records"))


def ingest_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part without header appended to a file."""
    rows = lineitem_records(spark, sf_dir)
    target, part = _path(spark), _path(spark)
    write_records(rows.where("barcode % 2 = 0"), target, _HEADER)
    write_records(rows.where("barcode % 2 = 1"), part, None)
    append_into(target, part)
    return read_records(spark, target)


def append_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_records(spark, sf_dir)
    path = _path(spark)
    write_records(rows.where("umi < 1000"), path, _HEADER)
    write_records(rows.where("umi >= 1000"), path, _HEADER, mode="append")
    return read_records(spark, path)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, totals = 0, np.zeros(3, np.int64)
    for b in batches:
        n += b.num_rows
        totals += [b.column(i).to_numpy(zero_copy_only=False).sum() for i in range(3)]
    yield pa.RecordBatch.from_pydict({"n_records": [n], "barcode_sum": [totals[0]], "umi_sum": [totals[1]], "index_sum": [totals[2]]})


def fold_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_records", "barcode_sum", "umi_sum", "index_sum")
    out = fold_columns(_filed(spark, sf_dir, partitions=6), _sums, ", ".join(f"{n} bigint" for n in names), dict.fromkeys(names, "sum"))
    return out.select(*(F.col(n).cast("bigint").alias(n) for n in names))


class SumProcessor(Processor):
    """Unsigned sums of the fields, records, batches and the partitions they were in, with the first and last record in their order."""

    def init(self, partition: int) -> dict:
        return {"parts": [partition], "n": 0, "sums": [0, 0, 0], "batches": 0, "ends": []}

    def process_batch(self, state: dict, batch: pa.RecordBatch) -> dict:
        rows = from_batch(batch)
        state["n"] += len(rows)
        for i, f in enumerate(FIELDS):
            state["sums"][i] += int((rows[f] >> np.uint64(32)).sum()) * (1 << 32) + int((rows[f] & np.uint64(0xFFFFFFFF)).sum())
        ends = [tuple(map(int, rows[i])) for i in (0, -1)]
        state["ends"] = [state["ends"][0] if state["ends"] else ends[0], ends[1]]
        return state

    def on_batch_complete(self, state: dict) -> dict:
        state["batches"] += 1
        return state

    def merge(self, left: dict, right: dict) -> dict:
        return {
            "parts": left["parts"] + right["parts"], "n": left["n"] + right["n"], "sums": [a + b for a, b in zip(left["sums"], right["sums"])],
            "batches": left["batches"] + right["batches"], "ends": [left["ends"][0], right["ends"][1]],
        }


class _Failing(SumProcessor):
    """Fails on a record whose index is 5."""

    def process_batch(self, state: dict, batch: pa.RecordBatch) -> dict:
        if (batch.column("index").to_numpy() == 5).any():
            raise ValueError("index 5")
        return state


_SUMMED = "n_records bigint, barcode_sum string, umi_sum string, index_sum string, first_barcode string, last_barcode string, n_partitions bigint, in_order boolean, whole_batches boolean"


def _summed(spark: SparkSession, s: dict) -> DataFrame:
    row = (
        s["n"], *map(str, s["sums"]), str(s["ends"][0][0]), str(s["ends"][1][0]), len(s["parts"]), s["parts"] == sorted(s["parts"]),
        s["batches"] >= len(s["parts"]),
    )
    return spark.createDataFrame([row], _SUMMED)


def fold_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processor of one's own over the rows of a sorted file in six partitions."""
    return _summed(spark, fold(_filed(spark, sf_dir, high=True, sort=True, partitions=6), SumProcessor()))


def fold_file_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by twenty tasks that read the file themselves, more than are merged at once."""
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir, True), path, _HEADER, sort=True)
    return _summed(spark, fold_file(spark, path, SumProcessor(), 20))


def fold_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failing processor gives, over rows and over a file, and one that doesn't meet the record."""
    path, found = _path(spark), []
    rows = lineitem_records(spark, sf_dir)
    write_records(rows, path, _HEADER)
    for case, run in (
        ("rows", lambda: fold(rows, _Failing())), ("file", lambda: fold_file(spark, path, _Failing(), 3)),
        ("without", lambda: fold(rows.where("index <> 5"), _Failing())),
    ):
        try:
            run()
            found.append((case, None, False))
        except RecordFileError as e:
            found.append((case, type(e).__name__, "index 5" in str(e)))
    return spark.createDataFrame(found, "case string, error string, names_cause boolean")


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by tasks that read the file themselves."""
    path = _path(spark)
    write_records(lineitem_records(spark, sf_dir, True), path, _HEADER)
    totals = scan_file(spark, path, 6)
    return totals.select("n_records", *(F.col(f"{f}_sum").cast("string").alias(f"{f}_sum") for f in ops.FIELDS), "checksum")


def partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = ops.record_count(_filed(spark, sf_dir))
    return count.select(F.explode(ops.partition_plan(F.col("n_records"), 4)).alias("p")).select("p.*")


def pattern_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    write_records(patterned_records(spark, _PATTERN), path, _HEADER)
    return ops.xor_checksum(read_records(spark, path))


def header_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of every header row."""
    return table(spark, sf_dir, "headers").distinct().select("file_id", header_error().alias("error"))


def record_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.record_hex(_filed(spark, sf_dir, high=True))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.from_json(ops.to_json(_filed(spark, sf_dir, high=True)))


def hi_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in unsigned order of the different records, top bits set in half of them."""
    return ops.with_positions(ops.distinct_triples(_filed(spark, sf_dir, high=True)), record_keys())


def hi_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _filed(spark, sf_dir, high=True)
    return rows.agg(
        u64_sum("barcode").cast("string").alias("exact_sum"), u64(u64_sum("barcode", wrapping=True)).cast("string").alias("wrapped_sum")
    )


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes as sequences of bases and back."""
    rows = lineitem_records(spark, sf_dir).select("barcode").distinct()
    text = decode_bases(F.col("barcode"), F.lit(16), "high")
    return rows.select("barcode", text.alias("bases"), encode_bases(text, "high").alias("again"))


def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the kind of feature their index stands for: a join on the bits."""
    features = F.broadcast(table(spark, sf_dir, "features").select("index", "feature_kind"))  # 3,000 rows at every scale
    rows = table(spark, sf_dir, "records").where("index is not null").join(features, "index", "left")
    return rows.groupBy("feature_kind").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (
        roundtrip, bulk_load, mmap_load, directory_layout, compressed_load, stream_barcode_counts, random_shape, file_errors, record_count, size_count, header_row, field_sums, index_sum, barcode_counts,
        xor_checksum, sorted_rank, slice_100_200, slice_sorted, single_record, verify_sorted, distinct_records, min_max_record,
        hi_min_max, record_order, ingest_concat, append_mode, fold_sums, scan_totals, partition_plan, pattern_checksum, header_validation,
        zstd_load, packed_errors, wrapped_errors, directory_append, append_mismatch, written_count, standard_streams, header_equality, top_unsigned,
        fold_processor, fold_file_sums, fold_error, record_hex, json_roundtrip, hi_sorted, hi_sums, bases, feature_counts,
    )
}

_R = 'r AS (SELECT l_orderkey AS barcode, l_partkey AS umi, CAST(l_linenumber AS BIGINT) AS "index" FROM lineitem)'
_BITS = "CASE WHEN l_orderkey % 2 = 1 THEN CAST(CAST(l_orderkey AS HUGEINT) - 9223372036854775808 AS BIGINT) ELSE l_orderkey END"
_H = f"""h AS (SELECT {_BITS} AS barcode, l_partkey AS umi, CAST(l_linenumber AS BIGINT) AS "index",
  CASE WHEN l_orderkey % 2 = 1 THEN CAST(l_orderkey AS HUGEINT) + 9223372036854775808 ELSE l_orderkey END AS b FROM lineitem)"""
_ALL = f'WITH {_R} SELECT barcode, umi, "index" FROM r'


def _little(value: str) -> str:
    digits = f"lpad(to_hex(CAST({value} AS UBIGINT)), 16, '0')"
    return " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(8))


def _bases_sql() -> str:
    digit = "substr('ACGT', CAST((barcode >> {}) & 3 AS INT) + 1, 1)"
    return " || ".join(digit.format(2 * i) for i in reversed(range(16)))


def _folded(parts: int) -> str:
    return f"""WITH {_H} SELECT count(*) AS n_records, CAST(sum(b) AS VARCHAR) AS barcode_sum, CAST(sum(umi) AS VARCHAR) AS umi_sum,
  CAST(sum("index") AS VARCHAR) AS index_sum, CAST(min(b) AS VARCHAR) AS first_barcode, CAST(max(b) AS VARCHAR) AS last_barcode,
  CAST({parts} AS BIGINT) AS n_partitions, true AS in_order, true AS whole_batches FROM h"""


ORACLE = {
    **dict.fromkeys(("roundtrip", "bulk_load", "mmap_load", "directory_layout", "compressed_load", "zstd_load", "standard_streams", "ingest_concat", "append_mode"), _ALL),
    "directory_append": f'WITH {_R} SELECT barcode, umi, "index", false AS claimed FROM r',
    "packed_errors": """SELECT "case", error, CAST(number AS BIGINT) AS number FROM (VALUES ('cut_record', 'TruncatedRecord', 32 + 19999 * 24),
  ('cut_stream', 'CompressionError', NULL), ('good', NULL, 20000)) AS t("case", error, number)""",
    "wrapped_errors": """SELECT * FROM (VALUES ('value', 'ProcessError', false), ('system', 'RecordIOError', false), ('own', 'InvalidIndex', true))
  AS t("case", error, same)""",
    "append_mismatch": """SELECT there, "case", error, CAST(n AS BIGINT) AS n_records FROM (VALUES ('file'), ('directory')) AS a(there),
  (VALUES ('lengths', 'RecordIOError', 100), ('other_layout', 'RecordIOError', 100), ('good', NULL, 200)) AS t("case", error, n)""",
    "written_count": "SELECT count(*) AS first_write, count(*) FILTER (l_partkey < 1000) AS append FROM lineitem",
    "header_equality": """SELECT count(*) AS n_headers, true AS same_by_json FROM (SELECT DISTINCT magic, version, bc_len, umi_len, flags, reserved FROM headers
  WHERE magic IS NOT NULL AND version IS NOT NULL AND bc_len IS NOT NULL AND umi_len IS NOT NULL AND flags IS NOT NULL AND reserved IS NOT NULL)""",
    "top_unsigned": f'WITH {_H} SELECT barcode, umi, "index" FROM h ORDER BY b DESC, umi DESC, "index" DESC LIMIT 10',
    "fold_processor": _folded(6),
    "fold_file_sums": _folded(20),
    "fold_error": """SELECT * FROM (VALUES ('rows', 'ProcessError', true), ('file', 'ProcessError', true), ('without', NULL, false))
  AS t("case", error, names_cause)""",
    **dict.fromkeys(("record_count", "size_count"), "SELECT count(*) AS n_records FROM lineitem"),
    "header_row": "SELECT 2 AS version, 16 AS bc_len, 12 AS umi_len, CAST(1 AS BIGINT) AS flags, true AS sorted",
    "field_sums": f"""WITH {_R} SELECT CAST(sum(barcode) AS BIGINT) AS barcode_sum, CAST(sum(umi) AS BIGINT) AS umi_sum,
  CAST(sum("index") AS BIGINT) AS index_sum, CAST(sum(barcode + umi + "index") AS BIGINT) AS total_sum FROM r""",
    "index_sum": f'WITH {_R} SELECT CAST(sum("index") AS BIGINT) AS index_sum FROM r',
    **dict.fromkeys(("barcode_counts", "stream_barcode_counts"), f"WITH {_R} SELECT barcode, count(*) AS n_records FROM r GROUP BY 1"),
    "random_shape": "SELECT CAST(10000 AS BIGINT) AS n_records, CAST(10000 AS BIGINT) AS n_in_range",
    "file_errors": """SELECT * FROM (VALUES ('zeros', 'InvalidMagicNumber'), ('magic_and_version', 'InvalidMagicNumber'), ('version', 'InvalidVersion'),
  ('barcode_length', 'InvalidBarcodeLength'), ('umi_length', 'InvalidUmiLength'), ('empty', 'RecordIOError'), ('short', 'RecordIOError'),
  ('cut_sequential', 'TruncatedRecord'), ('cut_bulk', 'InvalidMapSize'), ('cut_mmap', 'InvalidMapSize'), ('range_beyond', 'InvalidIndex'),
  ('range_empty', 'InvalidIndex'), ('good', NULL)) AS t("case", error)""",
    "xor_checksum": f'WITH {_R} SELECT bit_xor(xor(xor(barcode, umi), "index")) AS checksum FROM r',
    "sorted_rank": f'WITH {_R} SELECT *, row_number() OVER (ORDER BY barcode, umi, "index") - 1 AS position FROM r',
    "slice_100_200": f'WITH {_R} SELECT * FROM r ORDER BY barcode, umi, "index" LIMIT 100 OFFSET 100',
    "slice_sorted": f"""WITH {_H} SELECT barcode, umi, "index", position FROM
  (SELECT *, row_number() OVER (ORDER BY b, umi, "index") - 1 AS position FROM h) WHERE position BETWEEN 100 AND 199""",
    "single_record": f'WITH {_R} SELECT * FROM r ORDER BY barcode, umi, "index" LIMIT 1 OFFSET 50',
    "verify_sorted": "SELECT true AS unsigned_order, false AS signed_order",
    "distinct_records": f'WITH {_R} SELECT DISTINCT barcode, umi, "index" FROM r',
    "min_max_record": f"""WITH {_R} SELECT * FROM (SELECT 'min' AS which, * FROM r ORDER BY barcode, umi, "index" LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'max' AS which, * FROM r ORDER BY barcode DESC, umi DESC, "index" DESC LIMIT 1)""",
    "hi_min_max": f"""WITH {_H} SELECT * FROM (SELECT 'min' AS which, barcode, umi, "index" FROM h ORDER BY b, umi, "index" LIMIT 1)
  UNION ALL SELECT * FROM (SELECT 'max' AS which, barcode, umi, "index" FROM h ORDER BY b DESC, umi DESC, "index" DESC LIMIT 1)""",
    "record_order": f"""WITH {_H} SELECT (b, umi, "index") < (CAST(9223372036854775813 AS HUGEINT), 100, 3) AS before, count(*) AS n_records
  FROM h GROUP BY 1""",
    "fold_sums": f"""WITH {_R} SELECT count(*) AS n_records, CAST(sum(barcode) AS BIGINT) AS barcode_sum, CAST(sum(umi) AS BIGINT) AS umi_sum,
  CAST(sum("index") AS BIGINT) AS index_sum FROM r""",
    "scan_totals": f"""WITH {_H} SELECT count(*) AS n_records, CAST(sum(b) AS VARCHAR) AS barcode_sum, CAST(sum(umi) AS VARCHAR) AS umi_sum,
  CAST(sum("index") AS VARCHAR) AS index_sum, bit_xor(xor(xor(barcode, umi), "index")) AS checksum FROM h""",
    "partition_plan": """WITH n AS (SELECT count(*) AS n FROM lineitem) SELECT CAST(i AS INT) AS part, i * (n // 4) AS first_record,
  CASE WHEN i = 3 THEN n ELSE (i + 1) * (n // 4) END AS end_record FROM n, (SELECT range AS i FROM range(4))""",
    "pattern_checksum": f"""SELECT bit_xor(xor(xor(i % 1000000, (31 * i) % 1000000), i)) AS checksum
  FROM (SELECT range AS i FROM range({_PATTERN}))""",
    "header_validation": """SELECT file_id, CASE WHEN magic IS NULL OR magic <> 559235657 THEN 'InvalidMagicNumber'
  WHEN version IS NULL OR version <> 2 THEN 'InvalidVersion' WHEN bc_len IS NULL OR bc_len NOT BETWEEN 1 AND 32 THEN 'InvalidBarcodeLength'
  WHEN umi_len IS NULL OR umi_len NOT BETWEEN 1 AND 32 THEN 'InvalidUmiLength' END AS error FROM (SELECT DISTINCT * FROM headers)""",
    "record_hex": f"""WITH {_H} SELECT barcode, umi, "index", {_little('b')} || {_little('umi')} || {_little('"index"')} AS hex FROM h""",
    "json_roundtrip": f'WITH {_H} SELECT barcode, umi, "index" FROM h',
    "hi_sorted": f"""WITH {_H}, d AS (SELECT DISTINCT * FROM h)
  SELECT barcode, umi, "index", row_number() OVER (ORDER BY b, umi, "index") - 1 AS position FROM d""",
    "hi_sums": f"""WITH {_H} SELECT CAST(sum(b) AS VARCHAR) AS exact_sum, CAST(sum(b) % 18446744073709551616 AS VARCHAR) AS wrapped_sum FROM h""",
    "bases": f"""WITH {_R} SELECT barcode, {_bases_sql()} AS bases, barcode AS again FROM (SELECT DISTINCT barcode FROM r)""",
    "feature_counts": """SELECT feature_kind, count(*) AS n_rows FROM records r LEFT JOIN features f ON r."index" = f."index"
  WHERE r."index" IS NOT NULL GROUP BY 1""",
}
