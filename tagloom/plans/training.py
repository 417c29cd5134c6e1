"""Queries of the core operators for training data (problems 4 and 5) and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.profile import profile_files
from tagloom.operators.salted import salted_distinct_counts
from tagloom.session import small, table, written

#: A barcode is heavy in a file from one record in so many on.
P4_PART = 10
#: Fixed limits of the profile's issues.
P5_NULL_PART, P5_DISTINCT_PART, P5_SHIFT = 20, 20, 0.4003


def _shares(records: DataFrame, column: str) -> DataFrame:
    """``file_id, barcode`` of barcodes with at least a tenth of the records, of their file, that have one; ``column`` names the position."""
    counts = salted_distinct_counts(records.where("barcode is not null"), ["file_id", "barcode"], {"n": [column]}, nulls=("n",))
    counts = written(counts)
    totals = written(counts.groupBy(F.col("file_id").alias("f")).agg(F.sum("n").alias("total")))
    at = counts.join(small(totals, totals.count()), F.col("file_id").eqNullSafe(F.col("f")))
    return at.where(F.col("n") * P4_PART >= F.col("total")).select("file_id", "barcode")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes with at least a tenth of their file's records that have a barcode."""
    return _shares(table(spark, sf_dir, "records"), "rec_no")


def p4_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p4_found`` with all files taken as one and a record's file and position as one number: a few keys hold most rows, and are
    certain to be salted."""
    place = F.col("file_id") * (1 << 32) + F.col("rec_no")
    rows = table(spark, sf_dir, "records").select(F.lit(0).cast("bigint").alias("file_id"), "barcode", place.alias("place"))
    return _shares(rows, "place")


def p4_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, distinct UMIs and distinct indexes of every barcode."""
    return salted_distinct_counts(
        table(spark, sf_dir, "records").where("barcode is not null"),
        ["barcode"],
        {"n_records": ["file_id", "rec_no"], "n_umis": ["umi"], "n_indexes": ["index"]},
    )


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_files(table(spark, sf_dir, "records"), table(spark, sf_dir, "headers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the files that have records."""
    named = {"barcode": "bc_len", "umi": "umi_len"}
    length_name = F.when(F.col("column_name") == "barcode", named["barcode"]).otherwise(named["umi"])
    checks = [
        (F.col("column_name"), F.col("n_nulls") * P5_NULL_PART > F.col("n_records"), "null_rate"),
        (F.col("column_name"), F.col("n_distinct") * P5_DISTINCT_PART < F.col("n_values"), "few_values"),
        (F.col("column_name"), F.col("n_too_wide") > 0, "too_wide"),
        (F.col("column_name"), F.col("class_shift") > P5_SHIFT, "shift"),
        (length_name, F.col("declared_len").isNull() | ~F.col("declared_len").between(1, 32), "bad_length"),
    ]
    issues = F.array_compact(F.array(*(F.when(hit, F.struct(c.alias("column_name"), F.lit(i).alias("issue"))) for c, hit, i in checks)))
    return _profile(spark, sf_dir).select("file_id", F.explode(issues).alias("__i")).select("file_id", "__i.*")


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile, numbers rounded for display."""
    return _profile(spark, sf_dir).select(
        "file_id", "column_name", "library_id", "load_no", "declared_len", "n_records", "n_nulls", "n_distinct", "min_value", "max_value",
        *(F.col("quantiles")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75))),
        "n_too_wide", "prev_file_id", F.round("ks", 9).alias("ks"), F.round("class_shift", 9).alias("class_shift"),
    )


QUERIES = {"p4_found": p4_found, "p4_heavy": p4_heavy, "p4_barcodes": p4_barcodes, "p5_found": p5_found, "p5_profile": p5_profile}

_ONCE = "r AS (SELECT DISTINCT file_id, rec_no, barcode, umi, \"index\" FROM records)"
_PROFILE_SQL = f"""
WITH {_ONCE},
h AS (SELECT DISTINCT file_id, library_id, load_no, bc_len, umi_len FROM headers),
f AS (SELECT h.*, lag(file_id) OVER (PARTITION BY library_id ORDER BY load_no, file_id) AS prev_file_id
      FROM h WHERE file_id IN (SELECT file_id FROM r)),
v AS (SELECT file_id, 'barcode' AS column_name, barcode AS bits, CAST(CASE WHEN barcode < 0 THEN CAST(barcode AS HUGEINT) + 18446744073709551616 ELSE barcode END AS UBIGINT) AS val FROM r
      UNION ALL
      SELECT file_id, 'umi', umi, CAST(CASE WHEN umi < 0 THEN CAST(umi AS HUGEINT) + 18446744073709551616 ELSE umi END AS UBIGINT) FROM r),
l AS (SELECT f.*, 'barcode' AS column_name, bc_len AS declared_len FROM f UNION ALL SELECT f.*, 'umi', umi_len FROM f),
s AS (SELECT v.file_id, v.column_name, count(*) AS n_records, count(*) - count(val) AS n_nulls, count(val) AS n_values,
        count(DISTINCT val) AS n_distinct, arg_min(bits, val) AS min_value, arg_max(bits, val) AS max_value,
        sum(CASE WHEN declared_len BETWEEN 1 AND 32 THEN CASE WHEN declared_len < 32 AND CAST(val AS HUGEINT) >= CAST(1 AS HUGEINT) << (2 * declared_len) THEN 1 ELSE 0 END END) AS n_too_wide
      FROM v JOIN l ON v.file_id = l.file_id AND v.column_name = l.column_name GROUP BY 1, 2),
k AS (SELECT file_id, column_name, val, bits, count(*) OVER (PARTITION BY file_id, column_name ORDER BY val) AS upto,
        count(*) OVER (PARTITION BY file_id, column_name) AS n FROM v WHERE val IS NOT NULL),
q AS (SELECT file_id, column_name, arg_min(bits, val) FILTER (upto >= ceil(0.25 * n)) AS q25,
        arg_min(bits, val) FILTER (upto >= ceil(0.5 * n)) AS q50, arg_min(bits, val) FILTER (upto >= ceil(0.75 * n)) AS q75 FROM k GROUP BY 1, 2),
c AS (SELECT file_id, column_name, val & 15 AS class, count(*) * 1.0 / max(n) AS share FROM k GROUP BY 1, 2, 3),
g AS (SELECT l.file_id, l.column_name, t.class, coalesce(a.share, 0) AS a, coalesce(b.share, 0) AS b
      FROM l CROSS JOIN (SELECT CAST(range AS UBIGINT) AS class FROM range(16)) t
      LEFT JOIN c a ON a.file_id = l.file_id AND a.column_name = l.column_name AND a.class = t.class
      LEFT JOIN c b ON b.file_id = l.prev_file_id AND b.column_name = l.column_name AND b.class = t.class),
shift AS (SELECT file_id, column_name, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(abs(a - b)) / 2 END AS class_shift FROM g GROUP BY 1, 2),
p AS (SELECT l.file_id, l.column_name, e.val, CASE WHEN e.file_id = l.file_id THEN 1.0 / e.n ELSE -1.0 / e.n END AS step, e.file_id = l.file_id AS own
      FROM l JOIN k e ON e.column_name = l.column_name AND (e.file_id = l.file_id OR e.file_id = l.prev_file_id)),
d AS (SELECT file_id, column_name, sum(step) OVER (PARTITION BY file_id, column_name ORDER BY val) AS gap, own FROM p),
ks AS (SELECT file_id, column_name, CASE WHEN bool_or(own) AND NOT bool_and(own) THEN max(abs(gap)) END AS ks FROM d GROUP BY 1, 2)
"""

ORACLE = {
    "p4_found": """
WITH r AS (SELECT DISTINCT file_id, rec_no, barcode FROM records),
n AS (SELECT file_id, barcode, count(*) AS n FROM r WHERE barcode IS NOT NULL GROUP BY 1, 2)
SELECT file_id, barcode FROM (SELECT *, sum(n) OVER (PARTITION BY file_id) AS total FROM n) WHERE n * 10 >= total""",
    "p4_heavy": """
WITH r AS (SELECT DISTINCT file_id * 4294967296 + rec_no AS place, barcode FROM records),
n AS (SELECT barcode, count(*) AS n FROM r WHERE barcode IS NOT NULL GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS file_id, barcode FROM n WHERE n * 10 >= (SELECT sum(n) FROM n)""",
    "p4_barcodes": """
SELECT barcode, count(DISTINCT {'f': file_id, 'r': rec_no}) AS n_records, count(DISTINCT umi) AS n_umis, count(DISTINCT "index") AS n_indexes
FROM records WHERE barcode IS NOT NULL GROUP BY 1""",
    "p5_profile": _PROFILE_SQL
    + """SELECT l.file_id, l.column_name, library_id, load_no, declared_len, n_records, n_nulls, n_distinct, min_value, max_value,
  q25, q50, q75, CAST(n_too_wide AS BIGINT) AS n_too_wide, prev_file_id, round(ks, 9) AS ks, round(class_shift, 9) AS class_shift
FROM l JOIN s USING (file_id, column_name) LEFT JOIN q USING (file_id, column_name) LEFT JOIN shift USING (file_id, column_name) LEFT JOIN ks USING (file_id, column_name)""",
    "p5_found": _PROFILE_SQL
    + """SELECT file_id, column_name, 'null_rate' AS issue FROM s WHERE n_nulls * 20 > n_records
UNION ALL SELECT file_id, column_name, 'few_values' FROM s WHERE n_distinct * 20 < n_values
UNION ALL SELECT file_id, column_name, 'too_wide' FROM s WHERE n_too_wide > 0
UNION ALL SELECT file_id, column_name, 'shift' FROM shift WHERE class_shift > 0.4003
UNION ALL SELECT file_id, CASE WHEN column_name = 'barcode' THEN 'bc_len' ELSE 'umi_len' END, 'bad_length' FROM l
  WHERE declared_len IS NULL OR declared_len NOT BETWEEN 1 AND 32""",
}
