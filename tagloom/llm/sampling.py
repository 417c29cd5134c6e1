"""Uniform samples of fixed size from data whose size isn't known in advance.

Every record gets a random key; the sample is the records with the least keys. After counting, two bounds on
the key are set: with great probability fewer records than wanted lie below the first, and no fewer below the second.
What lies below the first is taken without further ado, what lies above the second is left; only the narrow waitlist
between them is sorted. If a bound fails, which the counts show, it is widened and the step is repeated.
"""

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import written

#: Hexadecimal digits of a key that are compared with a bound.
_DIGITS = 12
#: Probability that a bound fails at the first attempt.
RISK = 1e-4
#: Attempts with bounds; each squares the risk. Then the bounds are 0 and 1, which can't fail.
ATTEMPTS = 4


def random_key(seed: int, *columns: str) -> Column:
    """A key that is random by record but always the same for it: MD5 of seed and columns, in hexadecimal."""
    parts = [F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)]
    return F.md5(F.concat_ws(":", *parts))


def bounds(n: int, size: int, risk: float) -> tuple[float, float]:
    """(accept below, reject from) for a sample of ``size`` out of ``n``.

    By Bernstein's and Chernoff's inequalities more than ``size`` keys lie below the first, or fewer below the
    second, with probability ``risk`` at most.
    """
    if size >= n:
        return 1.0, 1.0
    p = size / n
    low = -log(risk) * 2 / 3 / n
    high = -log(risk) / n
    return max(0.0, p + low - sqrt(low * low + 3 * low * p)), min(1.0, p + high + sqrt(high * high + 2 * high * p))


def _digits(x: float) -> str:
    """``x`` as a bound on keys; "g" stands above all of them."""
    return "g" if x >= 1 else f"{int(x * 16**_DIGITS):0{_DIGITS}x}"


def accept_waitlist_sample(
    df: DataFrame, identity: list[str], size: int, sizes: dict[object, int], scopes: Column, seed: int = 0
) -> DataFrame:
    """``size`` rows of each scope, each row of a scope equally likely, as ``scope, *columns of df``.

    ``identity`` names the columns by which a row is one record; rows that agree in them are deliveries of one record and give
    one row. ``scopes`` is an array of scopes a row belongs to, ``sizes`` the number of different records of each scope. A
    scope with fewer records than ``size`` comes out whole. Ties of keys are broken by ``identity``. Sizes that aren't those of the
    data are an error.
    """
    spark = df.sparkSession
    todo = {s: n for s, n in sizes.items() if n}
    kind = df.select(F.explode(scopes).alias("s")).schema["s"].dataType.simpleString()
    columns = [F.col(f"`{c}`") for c in df.columns]
    done: DataFrame | None = None
    risk = RISK
    for attempt in range(ATTEMPTS + 1):
        if not todo:
            break
        limits = []
        for s, n in todo.items():
            take, leave = bounds(n, size, risk) if attempt < ATTEMPTS else (0.0, 1.0)
            limits.append((s, _digits(take), _digits(leave)))
        widest = max(x[2] for x in limits)
        named = spark.createDataFrame(limits, f"__scope {kind}, __take string, __leave string")
        near = (
            df.withColumn("__key", random_key(seed, *identity))
            .where(F.col("__key") < widest)
            .withColumn("__scope", F.explode(scopes))
            .join(F.broadcast(named), "__scope")
            .where("__key < __leave")
            .dropDuplicates(["__scope", *identity])
        )
        near = written(near)
        counts = {
            r["__scope"]: (r["taken"], r["all"])
            for r in near.groupBy("__scope").agg(F.count_if(F.col("__key") < F.col("__take")).alias("taken"), F.count(F.lit(1)).alias("all")).collect()
        }
        good = {}
        for s, n in todo.items():
            taken, every = counts.get(s, (0, 0))
            want = min(size, n)
            if taken <= want <= every:
                good[s] = want - taken
        accepted = near.where("__key < __take").where(F.col("__scope").isin(list(good)))
        parts = [accepted.select(F.col("__scope").alias("scope"), *columns)]
        # Every task sorts its part of the waitlist and hands on no more than is wanted, even if the waitlist is the whole scope.
        order = ["__key", *(F.col(f"`{c}`") for c in identity)]
        for s, room in good.items():
            if room:
                wait = near.where((F.col("__scope") == F.lit(s)) & (F.col("__key") >= F.col("__take")))
                parts.append(wait.orderBy(*order).limit(room).select(F.col("__scope").alias("scope"), *columns))
        for part in parts:
            done = part if done is None else done.unionByName(part)
        todo = {s: n for s, n in todo.items() if s not in good}
        risk *= risk
    if todo:
        raise ValueError(f"the sizes of the scopes {sorted(map(str, todo))} are not those of the data")
    if done is None:
        return df.select(F.lit(None).cast(kind).alias("scope"), *columns).limit(0)
    return done
