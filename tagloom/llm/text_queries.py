"""Queries of problems 6 to 8, on documents, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.frequencies import suffix_frequencies, text_suffixes
from tagloom.llm.packing import pack
from tagloom.llm.quality import common_path, statistics_column, text_counts
from tagloom.llm.tokens import count_column, decode_column, encode_column, model_of
from tagloom.session import table, written

#: Words of the longest sequences that are counted; up to so many occurrences one is rare, from this part of the texts on it is common.
P1_WORDS, P1_RARE, P1_COMMON_PART = 3, 2, 10
#: What parts words.
_BLANKS = "[ \\t\\r\\n]+"
#: Tokens of a container.
P7_CAPACITY = 4_096


def p1_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence of up to three words of the documents with its occurrences and the documents that hold it, marked where it is too
    rare or too common to tell documents apart. Words are what blanks and line ends part."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", _BLANKS), lambda w: w != "").alias("words"))
    n_docs = documents.where(F.size("words") > 0).count()
    found = suffix_frequencies(text_suffixes(documents, "doc_id", "words", P1_WORDS), P1_WORDS)
    return found.select(
        F.concat_ws(" ", *(f"t{k + 1}" for k in range(P1_WORDS))).alias("gram"), F.col("n").alias("n_words"), F.col("occurrences").alias("n_occurrences"),
        F.col("holders").alias("n_docs"), (F.col("occurrences") <= P1_RARE).alias("rare"), (F.col("holders") * P1_COMMON_PART >= n_docs).alias("common"),
    )


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", encode_column(F.col("text"), model_of(spark)).alias("ids"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, decoded from its token ids."""
    model = model_of(spark)
    return table(spark, sf_dir, "documents").select("doc_id", decode_column(encode_column(F.col("text"), model), model).alias("text"))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each of its parts, measured in tokens."""
    documents = table(spark, sf_dir, "documents").select("doc_id", count_column(F.col("text"), model_of(spark)).alias("n_tokens"))
    return pack(documents, "doc_id", "n_tokens", P7_CAPACITY).select(
        "container", F.col("item").alias("doc_id"), "part", F.col("start").alias("first_token"), F.col("size").alias("n_tokens")
    )


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing: every document is there once and whole, no container is over-full, and there are hardly more
    containers than the tokens fill, which leaves little space unused."""
    parts = written(p7_packing(spark, sf_dir))
    used = parts.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    fill = used.agg(
        F.count_if(F.col("used") > P7_CAPACITY).cast("int").alias("n_over_full"),
        (F.count(F.lit(1)) <= 1.01 * F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / P7_CAPACITY) + 1).alias("well_filled"),
    ).first()
    ends = F.col("first_token") + F.col("n_tokens")
    whole = parts.groupBy("doc_id").agg(
        ((F.max(ends) == F.sum("n_tokens")) & (F.count(F.lit(1)) == F.max("part") + 1) & ((F.max("part") == 0) | (F.max(ends) > P7_CAPACITY))).alias("whole")
    )
    documents = whole.agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("whole").alias("n_whole"))
    return documents.select("*", *(F.lit(x).alias(c) for c, x in fill.asDict().items()))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were split."""
    return p7_packing(spark, sf_dir).where("part = 1").select("doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and kind of every document."""
    common = common_path(table(spark, sf_dir, "common_words"))
    return table(spark, sf_dir, "documents").select("doc_id", statistics_column(F.col("text"), common).alias("s")).select("doc_id", "s.*")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts and shares of every document's whole text."""
    counts = {k: F.round(v, 9) if k.endswith("share") else v for k, v in text_counts(F.col("text")).items()}
    return table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in counts.items()))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return p8_statistics(spark, sf_dir).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


QUERIES = {"p1_grams": p1_grams, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p7_packing": p7_packing, "p7_fill": p7_fill, "p8_found": p8_found, "p8_statistics": p8_statistics, "p8_counts": p8_counts}
ORACLE = {
    "p1_grams": f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^{_BLANKS}|{_BLANKS}$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, regexp_split_to_array(t, '{_BLANKS}') AS w FROM t WHERE t <> ''),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, k AS n_words, array_to_string(w[i : i + k - 1], ' ') AS gram
      FROM p, (SELECT CAST(range AS INT) AS k FROM range(1, {P1_WORDS + 1})) WHERE i + k - 1 <= len(w))
SELECT gram, n_words, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_docs, count(*) <= {P1_RARE} AS rare,
  count(DISTINCT doc_id) * {P1_COMMON_PART} >= (SELECT count(*) FROM w) AS common FROM g GROUP BY 1, 2""",
    "p7_fill": """SELECT count(*) AS n_documents, count(*) AS n_whole, 0 AS n_over_full, true AS well_filled FROM documents""",
    "p8_counts": """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(line, '[.!?][ \\t\\r]*$')) AS ends, count(DISTINCT line) AS once
      FROM l WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY 1),
w AS (SELECT doc_id, count(*) AS n_words FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1)
SELECT doc_id, length(text) AS n_chars, CASE WHEN text IS NOT NULL THEN coalesce(n_lines, 0) END AS n_lines,
  CASE WHEN text IS NOT NULL THEN coalesce(n_words, 0) END AS n_words, CASE WHEN text IS NOT NULL THEN round(coalesce(ends / n_lines, 0), 9) END AS line_end_share,
  CASE WHEN text IS NOT NULL THEN round(coalesce((n_lines - once) / n_lines, 0), 9) END AS duplicate_share
FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN w USING (doc_id)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
