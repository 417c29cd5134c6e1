"""Queries of problems 1 to 3, on record tables, and their SQL."""

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.frequencies import value_frequencies
from tagloom.llm.sampling import accept_waitlist_sample
from tagloom.llm.top_values import top_values
from tagloom.operators.distinct import distinct_records
from tagloom.session import small, table

#: Up to so many records a value is rare; from this part of the files on it is common.
P1_RARE, P1_COMMON_PART = 2, 2
#: Part of all records with a barcode, and number of places of the ranking.
P2_PART, P2_PLACES = 500, 100
#: Records of each sample, and seed of its random keys.
P3_SIZE, P3_SEED = 50_000, 0


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct barcode and index with its records and files, marked where it can't tell files apart."""
    records = table(spark, sf_dir, "records")
    n_files = records.select("file_id").distinct().count()
    return value_frequencies(records).select(
        "*", (F.col("n_records") <= P1_RARE).alias("rare"), (F.col("n_files") * P1_COMMON_PART >= n_files).alias("common")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked values; one that is rare and common has two rows."""
    marks = F.array_compact(F.array(*(F.when(F.col(m), F.lit(m)) for m in ("rare", "common"))))
    return p1_values(spark, sf_dir).select("field", "value", F.explode(marks).alias("mark"))


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(table(spark, sf_dir, "records"), "barcode")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes that hold at least a 500th of all records with a barcode."""
    return top_values(_barcodes(spark, sf_dir), "barcode", share=Fraction(1, P2_PART)).select(F.col("value").alias("barcode"))


def p2_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent barcodes, and those that tie with the last of them."""
    return top_values(_barcodes(spark, sf_dir), "barcode", k=P2_PLACES).select(F.col("value").alias("barcode"), F.col("n").alias("n_records"))


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of all records, of those in files whose header has the sorted bit, and of those in files without.

    Rows without position are records of their own if their fields differ.
    """
    fields = ("barcode", "umi", "index")
    bare = F.when(F.col("rec_no").isNull(), F.concat_ws(",", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)))
    records = table(spark, sf_dir, "records").select("file_id", "rec_no", *fields, bare.alias("__bare"))
    bits = table(spark, sf_dir, "headers").groupBy("file_id").agg(F.max(F.col("flags").bitwiseAND(F.lit(1))).alias("bit"))
    per_file = distinct_records(records, "__bare").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    scope = F.when(F.col("bit") == 1, "sorted").when(F.col("bit") == 0, "unsorted")
    counts = {r["scope"]: r["n"] for r in per_file.join(bits, "file_id", "left").groupBy(scope.alias("scope")).agg(F.sum("n").alias("n")).collect()}
    sizes = {"all": sum(counts.values()), "sorted": counts.get("sorted", 0), "unsorted": counts.get("unsorted", 0)}
    rows = records.join(small(bits, bits.count()), "file_id", "left")
    sample = accept_waitlist_sample(rows, ["file_id", "rec_no", "__bare"], P3_SIZE, sizes, F.array_compact(F.array(F.lit("all"), scope)), P3_SEED)
    return sample.drop("bit", "__bare")


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p2_found": p2_found, "p2_top": p2_top, "p3_sample": p3_sample}

_FILES = "count(DISTINCT file_id) + max(CAST(file_id IS NULL AS BIGINT))"
_P1 = f"""
WITH r AS (SELECT DISTINCT file_id, rec_no, barcode, "index" FROM records), n AS (SELECT {_FILES} AS n FROM r),
u AS (SELECT 'barcode' AS field, barcode AS value, file_id FROM r UNION ALL SELECT 'index', "index", file_id FROM r),
v AS (SELECT field, value, count(*) AS n_records, {_FILES} AS n_files, count(*) <= 2 AS rare,
        ({_FILES}) * 2 >= (SELECT n FROM n) AS common FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
"""
_P2 = "WITH r AS (SELECT DISTINCT file_id, rec_no, barcode FROM records), n AS (SELECT barcode, count(*) AS n_records FROM r WHERE barcode IS NOT NULL GROUP BY 1) "

ORACLE = {
    "p1_values": _P1 + "SELECT * FROM v",
    "p1_found": _P1 + "SELECT field, value, 'rare' AS mark FROM v WHERE rare UNION ALL SELECT field, value, 'common' FROM v WHERE common",
    "p2_found": _P2 + "SELECT barcode FROM n WHERE n_records * 500 >= (SELECT sum(n_records) FROM n)",
    "p2_top": _P2 + "SELECT * FROM n WHERE n_records >= (SELECT min(n_records) FROM (SELECT n_records FROM n ORDER BY 1 DESC LIMIT 100))",
    "p3_sample": f"""
WITH r AS (SELECT DISTINCT file_id, rec_no, barcode, umi, "index", CASE WHEN rec_no IS NULL THEN coalesce(CAST(barcode AS VARCHAR), '') || ',' ||
  coalesce(CAST(umi AS VARCHAR), '') || ',' || coalesce(CAST("index" AS VARCHAR), '') END AS bare FROM records),
h AS (SELECT file_id, max(flags & 1) AS bit FROM headers GROUP BY 1),
s AS (SELECT 'all' AS scope, r.* FROM r UNION ALL
      SELECT CASE WHEN bit = 1 THEN 'sorted' ELSE 'unsorted' END, r.* FROM r JOIN h USING (file_id) WHERE bit IS NOT NULL)
SELECT scope, file_id, rec_no, barcode, umi, "index" FROM (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY md5('0:' || coalesce(CAST(file_id AS VARCHAR), '') || ':' ||
    coalesce(CAST(rec_no AS VARCHAR), '') || ':' || coalesce(bare, '')), file_id NULLS FIRST, rec_no NULLS FIRST, bare NULLS FIRST) AS place
  FROM s) WHERE place <= {P3_SIZE}""",
}
