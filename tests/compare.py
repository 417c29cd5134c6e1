"""Comparing query results with DuckDB over the same tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 7)
    if isinstance(x, Decimal):
        return int(x) if x == int(x) else float(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def check(spark, query, sql: str, folder: str = DATA) -> None:
    df = query(spark, folder)
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())


def write_tables(folder, spark, **tables) -> str:
    """Write (schema, rows) as parquet tables; the folder's path."""
    for name, (schema, data) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
