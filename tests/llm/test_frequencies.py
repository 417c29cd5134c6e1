import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tagloom.llm.frequencies import suffix_frequencies, text_suffixes, value_frequencies


def brute(docs, n):
    count, holders = Counter(), defaultdict(set)
    for doc, tokens in docs:
        for i in range(len(tokens or ())):
            for k in range(1, n + 1):
                if i + k <= len(tokens):
                    gram = tuple(tokens[i : i + k])
                    count[gram] += 1
                    holders[gram].add(doc)
    return {g: (count[g], len(holders[g])) for g in count}


def made(kind, seed=1, docs=60):
    r = random.Random(seed)
    words = list(range(-3, 4)) if kind == "bigint" else ["a", "b", "ba", "", "ω", "zz"]
    # One word holds a third of all places, one sequence a third of all rows.
    pick = lambda: words[0] if r.random() < 0.33 else r.choice(words)
    out = [(d, [pick() for _ in range(r.choice([0, 1, 2, 30, 60]) if d else 900)]) for d in range(docs)]
    return [*out, (docs, None), (docs + 1, [words[1]] * 300), (None, [words[2], words[0], words[0]] * 50)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("partitions", [1, 13])
def test_all_grams(spark, kind, n, partitions):
    docs = made(kind)
    df = spark.createDataFrame(docs, f"id bigint, words array<{kind}>").withColumn("doc", F.lit("x")).withColumn("t1", F.lit(0))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = suffix_frequencies(text_suffixes(df, "id", "words", n), n).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    found = {tuple(r[f"t{k + 1}"] for k in range(r["n"])): (r["occurrences"], r["holders"]) for r in got}
    assert len(found) == len(got)
    assert found == brute(docs, n)


def test_long_runs_over_chunks(spark, monkeypatch):
    from tagloom.operators import sorted_walk

    monkeypatch.setattr(sorted_walk, "CHUNK", 50)
    docs = made("bigint", 5)
    df = spark.createDataFrame(docs, "id bigint, words array<bigint>")
    got = suffix_frequencies(text_suffixes(df, "id", "words", 2), 2).collect()
    assert {tuple(r[f"t{k + 1}"] for k in range(r["n"])): (r["occurrences"], r["holders"]) for r in got} == brute(docs, 2)


def test_values(spark):
    r = random.Random(2)
    rows = []
    for n in range(4_000):
        row = (r.choice([None, 1, 2, 3, 4]), n, r.choice([7, 7, None, -1, r.randrange(500)]), r.choice([None, -1, 5]))
        rows += [row] * r.choice([1, 1, 3])
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "file_id bigint, rec_no bigint, barcode bigint, index bigint").withColumn("field", F.lit("clash")).repartition(5)
    got = {(x["field"], x["value"]): (x["n_records"], x["n_files"]) for x in value_frequencies(df).collect()}
    once = {(a, b): (c, d) for a, b, c, d in rows}
    count, files = Counter(), defaultdict(set)
    for (f, _), (barcode, index) in once.items():
        for name, v in (("barcode", barcode), ("index", index)):
            if v is not None:
                count[name, v] += 1
                files[name, v].add(f)
    assert got == {k: (count[k], len(files[k])) for k in count}


def test_nothing(spark):
    empty = spark.createDataFrame([], "file_id bigint, rec_no bigint, barcode bigint, index bigint")
    assert value_frequencies(empty).collect() == []
    nulls = spark.createDataFrame([(1, 1, None, None)], empty.schema)
    assert value_frequencies(nulls).collect() == []
