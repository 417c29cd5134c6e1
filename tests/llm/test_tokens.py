import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tagloom.llm.tokens import PATTERN, VOCABULARY, count_column, decode_column, encode_column, model_of, read_ranks


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(read_ranks(VOCABULARY))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "1", "é", "▁", " ", "\x1c", "\x00", " ", "😀", "你好", "<|endoftext|>", "½", "_", "é", "-", "The"]
    made = ["".join(r.choices(parts, k=r.randrange(60))) for _ in range(600)]
    plain = ["".join(r.choices("ab 's1\n\t\x1c\x0b.,_'re", k=r.randrange(60))) for _ in range(300)]
    return [*made, *plain, "", None, "x" * 50_000, "word " * 40_000, " " * 3_000, "\n\n \n", "<|endoftext|>", "ĠÃ", "�"]


def test_ids_counts_and_round_trip(spark, reference):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, text string").withColumn("ids", F.lit(1)).repartition(5)
    model = model_of(spark)
    ids = encode_column(F.col("text"), model)
    got = df.select("id", ids.alias("coded"), count_column(F.col("text"), model).alias("n"), decode_column(ids, model).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["id"]][1]
        assert r["coded"] == (reference.encode_ordinary(text) if text else [])
        assert r["n"] == len(r["coded"])
        assert r["back"] == (text or "")


def test_empty_table_and_null_ids(spark):
    model = model_of(spark)
    none = spark.createDataFrame([], "text string")
    assert none.select(encode_column(F.col("text"), model)).collect() == []
    df = spark.createDataFrame([(None,), ([],), ([0, 50255],)], "ids array<int>")
    assert [r[0] for r in df.select(decode_column(F.col("ids"), model)).collect()][:2] == [None, ""]


def test_gaps_in_ranks_are_an_error(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        read_ranks(str(tmp_path / "v"))
