"""Distinct counts per key without tasks that do most of the work: two-stage salted aggregation.

Keys with many rows are found on a sample and get a salt. Their rows are shuffled by (key, salt), where partial results are computed,
and the partial results are merged by the key itself; the other keys are counted in one step.
"""

from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: One row in so many, chosen by hash, is looked at to find heavy keys.
SAMPLE_EVERY = 64
#: A key is heavy from this part of an average partition on, and gets so many salts for each such part it fills.
HEAVY_PART, SALTS = 0.125, 2


def heavy_keys(rows: DataFrame, keys: list[str], spread: list[str], partitions: int) -> list[tuple]:
    """(key values..., parts) of keys with at least ``HEAVY_PART / partitions`` of the sampled rows, in one pass over them.

    ``parts`` is the size in such parts. As shares add up to 1, there are at most ``partitions / HEAVY_PART`` such keys,
    whatever the data. A key that the sample misses or wrongly takes only costs time.
    """
    share = HEAVY_PART / partitions
    seen = Observation()
    picked = rows.where(F.pmod(F.xxhash64(*spread, F.lit(7)), F.lit(SAMPLE_EVERY)) == 0).observe(seen, F.count(F.lit(1)).alias("total"))
    counts = picked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    most = counts.orderBy(F.desc("__n")).limit(ceil(1 / share)).collect()
    if not most:
        return []
    least = share * seen.get["total"]
    return [(*r[:-1], max(2, round(r[-1] / least))) for r in most if r[-1] >= least]


def salted_distinct_counts(
    df: DataFrame, keys: list[str], measures: dict[str, list[str]], partitions: int | None = None, nulls: tuple[str, ...] = ()
) -> DataFrame:
    """For every key the number of distinct values of each measure: ``*keys, *measures`` (bigint, 0 without a value).

    ``measures`` maps a result name to the columns of the counted value. A value of one column is none if it is null, unless ``nulls`` names
    the measure; in a value of several columns null is a part like others. Keys are taken with their nulls, as by GROUP BY.

    The salt of a row of a heavy key is a hash of the counted value, not a random number: one value always gets one salt, so that
    partial distinct counts of a key add up exactly and repeated tasks give equal rows. Key and salt alone decide where a row goes, and
    the rows of a key and salt are about a sixteenth of an average partition.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = list(dict.fromkeys([*keys, *(c for m in measures.values() for c in m)]))
    names = {c: f"__k{i}" if c in keys else f"__v{i}" for i, c in enumerate(columns)}
    inner = [names[k] for k in keys]
    rows = df.select(*(F.col(f"`{c}`").alias(names[c]) for c in columns))
    spread = [n for n in names.values() if n not in inner] or inner
    heavy = heavy_keys(rows, inner, spread, partitions)

    def there(name: str) -> Column:
        several = len(measures[name]) > 1 or name in nulls
        return F.lit(True) if several else F.col(names[measures[name][0]]).isNotNull()

    # Rows of (key, measure, value), a row for each measure that has a value; parts of other measures are null.
    valued = list(dict.fromkeys(names[c] for m in measures.values() for c in m))
    kinds = {n: rows.schema[n].dataType for n in valued}

    def apart(df: DataFrame, *more: str) -> DataFrame:
        each = F.array(
            *(
                F.struct(
                    F.lit(i).alias("__m"),
                    there(m).alias("__there"),
                    *((F.col(n) if n in {names[c] for c in measures[m]} else F.lit(None).cast(kinds[n])).alias(f"__x{n}") for n in valued),
                )
                for i, m in enumerate(measures)
            )
        )
        return df.select(*inner, *more, F.explode(each).alias("__e")).select(*inner, *more, "__e.*")

    values = [f"__x{n}" for n in valued]

    def numbers(df: DataFrame) -> DataFrame:
        by_measure = (F.sum(F.when(F.col("__m") == i, F.col("__n"))) for i in range(len(measures)))
        return df.groupBy(*inner).agg(*(F.coalesce(s, F.lit(0)).cast("bigint").alias(m) for s, m in zip(by_measure, measures)))

    def direct(df: DataFrame) -> DataFrame:
        """Counts in one shuffle by key: what comes after it keeps that partitioning. Several distinct aggregates at once would
        shuffle again, by key and value."""
        df = df.repartition(*inner)
        if len(measures) == 1:
            (m,) = measures
            return df.distinct().groupBy(*inner).agg(F.count_if(there(m)).alias(m))
        distinct = apart(df).select(*inner, "__m", "__there", *values).distinct()
        return numbers(distinct.groupBy(*inner, "__m").agg(F.count_if("__there").alias("__n")))

    out = [*(F.col(names[k]).alias(k) for k in keys), *measures]
    if not heavy:
        return direct(rows).select(*out)

    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in inner), "__parts int"])
    listed = spark.createDataFrame(heavy, schema).select("__parts", *(F.col(k).alias(f"__h{k}") for k in inner))  # as many as heavy_keys allows
    same = F.lit(True)
    for k in inner:
        same = same & F.col(k).eqNullSafe(F.col(f"__h{k}"))
    marked = rows.join(F.broadcast(listed), same, "left").drop(*(f"__h{k}" for k in inner))
    light = direct(marked.where(F.col("__parts").isNull()).drop("__parts"))
    # Salts of the measures follow one another. Rows without a value stand for their key in one salt, from each task once.
    salts = F.col("__parts") * SALTS
    salt = (F.col("__m") * salts + F.pmod(F.xxhash64(*values), salts)).cast("int")
    partial = (
        apart(marked.where(F.col("__parts").isNotNull()), "__parts")
        .select(*inner, "__m", "__there", *values, salt.alias("__salt"))
        .repartition(*inner, "__salt")
        .distinct()
        .groupBy(*inner, "__salt", "__m")
        .agg(F.count_if("__there").alias("__n"))
    )
    return light.unionByName(numbers(partial)).select(*out)
