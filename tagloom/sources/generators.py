"""Made-up records for tests and benchmarks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.header import Header


def random_records(
    spark: SparkSession, n: int, *, barcodes: int = 1_000, max_index: int = 10_000, bc_len: int = 16, umi_len: int = 12, seed: int = 0
) -> tuple[Header, DataFrame]:
    """A valid header and ``n`` records: barcode in [0, barcodes), index in [0, max_index), UMI any 64 bits.

    The same seed gives the same records. UMIs don't fit ``umi_len``, which is on purpose: values are never checked against it.
    """
    header = Header(bc_len, umi_len).validate()
    ids = spark.range(n)
    pick = lambda salt, below: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(below).cast("bigint"))
    return header, ids.select(
        pick(1, barcodes).alias("barcode"), F.xxhash64("id", F.lit(seed), F.lit(2)).alias("umi"), pick(3, max_index).alias("index")
    )


def patterned_records(spark: SparkSession, n: int) -> DataFrame:
    """barcode = i mod 10^6, umi = 31 i mod 10^6, index = i."""
    i = F.col("id")
    return spark.range(n).select((i % 1_000_000).alias("barcode"), (i * 31 % 1_000_000).alias("umi"), i.alias("index"))
