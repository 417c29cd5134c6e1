import random

import pytest

from tagloom.llm.queries import ORACLE, QUERIES
from tests.compare import DATA, check, write_tables


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    documents = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in ("p6_ids", "p8_statistics"):
        assert len(rows) == documents
    elif name == "p7_packing":
        assert len({r["doc_id"] for r in rows}) == documents
        assert sum(r["n_tokens"] for r in rows) > 0


def test_split_documents_are_the_long_ones(spark):
    ids = {r["doc_id"]: len(r["ids"]) for r in QUERIES["p6_ids"](spark, DATA).collect()}
    assert {r[0] for r in QUERIES["p7_found"](spark, DATA).collect()} == {d for d, n in ids.items() if n > 4_096}


def test_empty_tables(spark, tmp_path):
    folder = write_tables(
        tmp_path,
        spark,
        records=("file_id bigint, piece_id bigint, rec_no bigint, barcode bigint, umi bigint, index bigint", []),
        headers=("file_id bigint, library_id bigint, load_no int, bc_len int, umi_len int, flags bigint", []),
        documents=("doc_id bigint, text string", []),
        common_words=("lang string, word string", []),
    )
    for name, query in QUERIES.items():
        found = [tuple(r) for r in query(spark, folder).collect()]
        assert found == ([(0, 0, 0, True)] if name == "p7_fill" else []), name


RECORDS = "file_id bigint, piece_id bigint, rec_no bigint, barcode bigint, umi bigint, index bigint"
HEADERS = "file_id bigint, library_id bigint, load_no int, bc_len int, umi_len int, flags bigint"


@pytest.mark.parametrize("name", ["p1_found", "p1_values", "p2_found", "p2_top", "p3_sample"])
def test_null_files_and_positions_match_sql(spark, tmp_path, name):
    """Nulls in every column, repeated rows, and rows without position that differ."""
    r = random.Random(3)
    rows = []
    for i in range(3_000):
        pick = lambda *some: r.choice([None, *some])
        row = (pick(1, 2, 3, -(1 << 63)), 0, pick(i, i, i, i % 7), pick(7, 7, r.randrange(60)), pick(1, r.randrange(9)), pick(-1, 5))
        # Rows of one file and position are deliveries of one record, unless the position is unknown.
        rows += [row if row[2] is None else (*row[:3], row[2] % 50, row[2] % 3, None if row[2] % 2 else 4)] * r.choice([1, 2])
    heads = [(1, 1, 1, 16, 12, 1), (2, 1, 2, 16, 12, 0), (2, 1, 2, 16, 12, 0), (None, 1, 2, 16, 12, 1), (3, 1, 2, 16, 12, None)]
    check(spark, QUERIES[name], ORACLE[name], write_tables(tmp_path, spark, records=(RECORDS, rows), headers=(HEADERS, heads)))
