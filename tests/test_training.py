"""Distinct records, salted counts and file profiles against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.functions.unsigned import MASK, from_bits, to_bits
from tagloom.operators import profile, sorted_walk
from tagloom.operators.distinct import distinct_records
from tagloom.operators.profile import profile_files
from tagloom.operators.salted import SALTS, heavy_keys, salted_distinct_counts
from tests.compare import check, plain, write_tables

RECORDS = "file_id bigint, piece_id bigint, rec_no bigint, barcode bigint, umi bigint, index bigint"
HEADERS = "file_id bigint, library_id bigint, load_no int, bc_len int, umi_len int, flags bigint"


def made_records(seed=0, files=9, size=300, hot=0.4):
    r = random.Random(seed)
    rows = []
    for f in range(files):
        for n in range(size * (6 if f == 1 else 1)):
            barcode = 77 if r.random() < hot else r.choice([r.getrandbits(64), r.randrange(40), None])
            umi = r.choice([r.randrange(50), r.getrandbits(64), MASK, None])
            row = (f, 0, n, barcode, umi, r.choice([None, MASK, r.randrange(9)]))
            rows += [row] * r.choice([1, 1, 1, 3])
    r.shuffle(rows)
    return [tuple(None if x is None else to_bits(x) for x in row) for row in rows]


@pytest.fixture(scope="module")
def rows():
    return made_records()


@pytest.fixture(scope="module")
def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS).withColumn("n", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(6)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def once(rows):
    return {(r[0], r[2]): r for r in rows}


def test_distinct_records(records, rows):
    df = distinct_records(records, "barcode", "umi")
    assert plan_of(df).count("passthrough") == 1
    assert sorted(((r[0], r[2]) for r in df.collect())) == sorted(once(rows))
    assert df.columns == ["file_id", "bucket", "rec_no", "barcode", "umi"]


def test_distinct_records_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 1, 5, 5, 5)] * 2 + [(1, 0, None, 5, 5, 5)] * 2 + [(1, 0, None, 5, 6, 5)], RECORDS)
    assert distinct_records(df).count() == 2
    assert distinct_records(df, "umi").count() == 3


def test_whole_groups_are_linear_in_a_long_group(monkeypatch):
    """Every row is joined a bounded number of times, however long its group; groups come out whole."""
    monkeypatch.setattr(sorted_walk, "CHUNK", 1_000)
    copied = []
    real = np.concatenate
    monkeypatch.setattr(sorted_walk.np, "concatenate", lambda parts: (copied.append(sum(map(len, parts))), real(parts))[1])
    key = real([np.zeros(3, np.int64), np.full(200_000, 5), np.arange(6, 2_506), np.full(999, 9_000)])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 300]), pa.array(np.arange(len(key))[i : i + 300])], names=["k", "v"]) for i in range(0, len(key), 300)]
    out = list(sorted_walk.whole_groups(iter(batches), [0]))
    assert sum(copied) <= 3 * 2 * len(key)
    assert real([c[1] for c, _, _ in out]).tolist() == list(range(len(key)))
    assert all(a[0][0][-1] != b[0][0][0] for a, b in zip(out, out[1:]))
    assert [f for _, f, _ in out] == [True] + [False] * (len(out) - 1) and [x for _, _, x in out] == [False] * (len(out) - 1) + [True]


def test_a_value_in_every_block_shrinks_to_a_row_a_bucket(spark):
    """Whatever the rows of a value, what is sorted of it is bounded by the number of buckets."""
    df = spark.range(2_000_000).select(F.lit(1).alias("file_id"), F.col("id").alias("rec_no"), F.lit(7).alias("barcode"))
    counted = distinct_records(df, "barcode").groupBy("bucket", "file_id", "barcode").agg(F.count(F.lit(1)).alias("n"))
    assert plan_of(counted).count("Exchange ") == 1
    n = [r["n"] for r in counted.collect()]
    assert len(n) <= 8 and sum(n) == 2_000_000


def by_key(rows, key, measures):
    """Values by key; a value that is None is none, one within a tuple is."""
    out = defaultdict(lambda: [set() for _ in measures])
    for r in rows:
        found = out[key(r)]
        for place, m in enumerate(measures):
            if (v := m(r)) is not None:
                found[place].add(v)
    return {k: tuple(map(len, v)) for k, v in out.items()}


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_salted_counts(records, rows, partitions):
    got = salted_distinct_counts(
        records, ["barcode"], {"n_records": ["file_id", "rec_no"], "n_umis": ["umi"], "n": ["index"]}, partitions
    )
    assert got.columns == ["barcode", "n_records", "n_umis", "n"]
    expected = by_key(rows, lambda r: (r[3],), [lambda r: (r[0], r[2]), lambda r: r[4], lambda r: r[5]])
    assert {(r[0],): tuple(r[1:]) for r in got.collect()} == expected


@pytest.mark.parametrize("nulls", [(), ("n",)])
def test_salted_counts_by_two_keys_with_nulls(spark, rows, nulls):
    """Keys and positions may be null; both light and heavy keys are there."""
    r = random.Random(5)
    some = [(r.choice([None, row[0]]), 0, r.choice([None, row[2]]), *row[3:]) for row in rows]
    df = spark.createDataFrame(some, RECORDS).repartition(5)
    named = df.select(F.col("file_id").alias("a"), F.col("barcode").alias("b"), F.col("rec_no").alias("c"))
    assert any(None in h for h in heavy_keys(named, ["a", "b"], ["c"], 8))
    got = salted_distinct_counts(df, ["file_id", "barcode"], {"n": ["rec_no"]}, 8, nulls)
    one = (lambda x: (x[2],)) if nulls else (lambda x: x[2])
    assert {tuple(x[:2]): (x[2],) for x in got.collect()} == by_key(some, lambda x: (x[0], x[3]), [one])


def test_heavy_keys_are_found_and_few(records):
    named = records.select(F.col("barcode").alias("k"), F.col("file_id").alias("a"), F.col("rec_no").alias("b")).dropna()
    found = heavy_keys(named, ["k"], ["a", "b"], 4)
    assert 77 in {r[0] for r in found} and len(found) <= 32
    assert dict(found)[77] > 2


def test_salt_alone_spreads_a_heavy_key(spark):
    """Rows of a heavy key are shuffled by key and salt, by nothing else, and then by key; they fill all partitions about alike."""
    df = spark.range(400_000).select(F.when(F.col("id") % 100 < 90, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    got = salted_distinct_counts(df, ["k"], {"n": ["id"]}, 8)
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(got))
    assert [re.sub(r"#\d+L?|, \d+$", "", x) for x in shuffles] == ["__k0", "__k0", "__k0, __salt"]
    assert {r[0]: r[1] for r in got.where("k = 1 or n <> 1").collect()} == {1: 360_000}
    salts = 58 * SALTS  # nine tenths of eight partitions are so many eighths
    placed = df.where("k = 1").withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).repartition(8, "k", "s")
    sizes = sorted(r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_salted_counts_of_little(spark):
    empty = spark.createDataFrame([], RECORDS)
    measures = {"n_records": ["file_id", "rec_no"], "n_umis": ["umi"]}
    assert salted_distinct_counts(empty, ["barcode"], measures).collect() == []
    nulls = spark.createDataFrame([(1, 1, n, 9, None, None) for n in range(2_000)] + [(1, 1, 0, None, 1, 1)], RECORDS)
    assert sorted(tuple(r) for r in salted_distinct_counts(nulls, ["barcode"], measures, 2).collect() if r[0]) == [(9, 2_000, 0)]
    only_null = salted_distinct_counts(nulls, ["barcode"], {"n_umis": ["umi"]}, 2)
    assert sorted(tuple(r) for r in only_null.collect() if r[0]) == [(9, 0)]


@pytest.mark.parametrize("name", ["p4_found", "p4_heavy", "p4_barcodes"])
def test_null_files_and_positions_match_sql(spark, tmp_path, name):
    from tagloom.plans.training import ORACLE, QUERIES

    r = random.Random(3)
    data = [(r.choice([None, 1, 2]), 0, r.choice([None, n, n]), r.choice([None, 7, n % 9]), r.choice([None, 1]), r.choice([None, n])) for n in range(3_000)]
    check(spark, QUERIES[name], ORACLE[name], write_tables(tmp_path, spark, records=(RECORDS, data * 2)))


def brute_profile(rows, heads):
    """(file, column) -> what profile_files gives, by sorting each file by itself."""
    files = defaultdict(list)
    for r in once(rows).values():
        if r[0] is not None:
            files[r[0]].append(r)
    head = {f: max((h for h in heads if h[0] == f), default=(f, None, None, None, None, None)) for f in files}
    libraries = defaultdict(list)
    for f in files:
        library = head[f][1]
        libraries[library if library is not None else ("alone", f)].append(f)
    out = {}
    for group in libraries.values():
        group.sort(key=lambda f: (head[f][2] is not None, head[f][2] or 0, f))
        for i, f in enumerate(group):
            for c, name in ((3, "barcode"), (4, "umi")):
                values = np.sort(np.array([from_bits(r[c]) for r in files[f] if r[c] is not None], np.uint64))
                before = group[i - 1] if i else None
                other = np.sort(np.array([from_bits(r[c]) for r in files.get(before, []) if r[c] is not None], np.uint64))
                length = head[f][c]
                ks = shift = None
                if len(values) and len(other):
                    at = np.union1d(values, other)
                    share = lambda v: np.searchsorted(v, at, "right") / len(v)
                    ks = float(np.abs(share(values) - share(other)).max())
                    bins = lambda v: np.bincount((v & np.uint64(15)).astype(int), minlength=16) / len(v)
                    shift = float(np.abs(bins(values) - bins(other)).sum() / 2)
                q = [to_bits(int(values[max(1, int(np.ceil(s * len(values)))) - 1])) for s in profile.QUANTILES] if len(values) else None
                wide = sum(int(v) >= 4**length for v in values) if length is not None and 1 <= length <= 32 else None
                out[f, name] = plain((
                    length, len(files[f]), len(files[f]) - len(values), len(values), len(set(values.tolist())),
                    to_bits(int(values[0])) if len(values) else None, to_bits(int(values[-1])) if len(values) else None,
                    q, wide, before, ks, shift,
                ))
    return out


def spark_profile(spark, rows, heads):
    df = profile_files(
        spark.createDataFrame(rows, RECORDS).withColumn("gid", F.lit(1)).repartition(5),
        spark.createDataFrame(heads, HEADERS).withColumn("o", F.lit("clash")),
    )
    columns = (
        "declared_len", "n_records", "n_nulls", "n_values", "n_distinct", "min_value", "max_value", "quantiles", "n_too_wide",
        "prev_file_id", "ks", "class_shift",
    )
    return {(r["file_id"], r["column_name"]): plain(tuple(r[c] for c in columns)) for r in df.collect()}


HEADS = [
    (0, 1, 5, 16, 12, 1), (1, 1, 2, 3, None, 0), (2, 1, 9, 32, 4, 0), (3, 2, 1, 0, 33, 1), (4, 2, None, 16, 12, 0), (5, None, 1, 16, 12, 0),
    (6, None, 1, 20, 20, 0), (7, 3, 4, 1, 31, 0), (7, 3, 4, 1, 31, 0), (99, 3, 1, 16, 12, 0),
]


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_profile(spark, rows, partitions):
    """Many partitions cut groups, even single files, into parts that must be merged."""
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert spark_profile(spark, rows, HEADS) == brute_profile(rows, HEADS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_profile_of_a_library_with_many_loads(spark, monkeypatch):
    monkeypatch.setattr(profile, "LOADS", 4)
    rows = made_records(3, files=23, size=40, hot=0.2)
    heads = [(f, 1, 100 - f, 16, 12, 0) for f in range(23)]
    assert spark_profile(spark, rows, heads) == brute_profile(rows, heads)


def test_profile_ties_and_single_values(spark):
    rows = [(f, 0, n, 7, None if f == 2 else n % 2, 0) for f in range(4) for n in range(200)]
    heads = [(f, 1, f, 16, 12, 0) for f in range(4)]
    assert spark_profile(spark, rows, heads) == brute_profile(rows, heads)


def test_profile_of_nothing(spark):
    assert spark_profile(spark, [], HEADS) == {}
    assert spark_profile(spark, [(1, 0, 0, None, None, None)], []) == brute_profile([(1, 0, 0, None, None, None)], [])
    assert spark_profile(spark, [(None, 0, 0, 1, 1, 1)], HEADS) == {}


def test_entry_and_queries_match_sql(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)


def _core():
    from tagloom.plans import records, training

    return [(n, f, part.ORACLE[n]) for part in (records, training) for n, f in part.QUERIES.items()]


@pytest.mark.parametrize("name, query, sql", _core(), ids=lambda x: x if isinstance(x, str) and len(x) < 25 else "")
def test_query(spark, name, query, sql):
    check(spark, query, sql)


def test_core_doesnt_need_llm(tmp_path):
    """A copy without the subpackage, but with what Python may have left in its folder, has the core's queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for source in (root / "tagloom").rglob("*.py"):
        if "llm" not in source.parts:
            assert "tagloom.llm" not in source.read_text()
    shutil.copytree(root / "tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    for stale in (False, True):
        if stale:
            (tmp_path / "tagloom/llm/__pycache__").mkdir(parents=True)
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
