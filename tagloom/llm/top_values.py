"""The most frequent values of a column, exactly, in memory that doesn't grow with the number of distinct values.

Values are hashed one-to-one to 64 bits. Each round counts hash prefixes by SQL. The count of a prefix is an upper bound of every
value below it, so only prefixes that may beat the lower bound of the k-th most frequent value are retained and
lengthened in the next round, until each stands for one value.
"""

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import written

#: Bits of the prefixes by round; the last are whole hashes, which stand for one value each.
PREFIX_BITS = (12, 20, 28, 36, 44, 52, 64)
#: Prefixes that are retained as a list, at most; beyond it a round goes without a list, over all rows.
RETAINED = 100_000


def _prefix(bits: int):
    return F.shiftrightunsigned("__h", 64 - bits) if bits < 64 else F.col("__h")


def top_values(df: DataFrame, column: str, k: int | None = None, share: Fraction | float | None = None) -> DataFrame:
    """``value, n``: the ``k`` most frequent non-null values with all ties of the k-th, or those with at least ``share`` of the
    non-null rows, or those that fulfil both, with exact counts.

    With ``share`` a round retains at most ``1 / share`` prefixes. With ``k`` the lower bound is the k-th greatest of exact
    counts of single values: one candidate is drawn from each retained prefix and counted in the next round, and
    prefixes that hold one value only are counted already. If so many values tie that more than ``RETAINED`` prefixes may
    still win, the round groups all rows, which spills instead of filling memory. Null or empty input gives no rows.
    """
    if k is None and share is None:
        raise ValueError("k or share is needed")
    spark = df.sparkSession
    rows = written(df.select(F.col(f"`{column}`").alias("__v")).where("__v is not null"))
    kind = rows.schema["__v"].dataType.simpleString()
    rows = rows.withColumn("__h", F.xxhash64("__v"))
    total = rows.count()
    least = max(1, ceil(total * Fraction(share))) if share is not None else 1
    kept: list[tuple] | None = None
    for step, bits in enumerate(PREFIX_BITS):
        whole = bits == 64
        keys = [_prefix(bits).alias("__p"), *([F.col("__v").alias("__value")] if whole else [])]
        source = rows
        if kept is not None:
            before = PREFIX_BITS[step - 1]
            listed = spark.createDataFrame(kept, f"__q bigint, __candidate {kind}")
            source = rows.withColumn("__q", _prefix(before)).join(F.broadcast(listed), "__q")
        else:
            source = rows.withColumn("__candidate", F.lit(None).cast(kind))
        counted = source.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("__v").alias("low"),
            F.max("__v").alias("high"),
            F.any_value("__v").alias("candidate"),
            F.count_if(F.col("__v") == F.col("__candidate")).alias("candidate_n"),
        )
        if whole:
            return _best(counted.select(F.col("__value").alias("value"), "n"), k, least)
        counted = written(counted)
        if k is not None:
            # Exact counts of different values; the k-th greatest is a lower bound of the k-th place.
            sure = counted.select(F.greatest(F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(0), "candidate_n").alias("n"))
            best = [r["n"] for r in sure.where("n > 0").orderBy(F.desc("n")).limit(k).collect()]
            least = max(least, best[-1] if len(best) == k else 1)
        left = counted.where(F.col("n") >= least)
        if left.where("low <> high").isEmpty():
            return _best(left.select(F.col("low").alias("value"), "n"), k, least)
        found = left.select("__p", "candidate").limit(RETAINED + 1).collect()
        kept = [tuple(r) for r in found] if len(found) <= RETAINED else None
    raise AssertionError("the last prefix is a whole hash")


def _best(values: DataFrame, k: int | None, least: int) -> DataFrame:
    values = values.where(F.col("n") >= least)
    if k is None:
        return values
    values = written(values)
    places = [r["n"] for r in values.select("n").orderBy(F.desc("n")).limit(k).collect()]
    return values.where(F.col("n") >= places[-1]) if places else values
