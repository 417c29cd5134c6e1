"""Unsigned 64-bit values kept as BIGINT bit patterns.

Equality, hashing, grouping and XOR act on the bits and need nothing; ordering and
arithmetic go through these functions.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
MIN = -(1 << 63)
_TWO64 = "18446744073709551616BD"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_bits(value: int) -> int:
    """The signed 64-bit integer with the bits of the unsigned ``value``."""
    if not 0 <= value <= MASK:
        raise ValueError(f"{value} is no unsigned 64-bit value")
    return value - (1 << 64) if value >> 63 else value


def from_bits(bits: int) -> int:
    """The unsigned value of a signed 64-bit integer."""
    return bits & MASK


def lit_u64(value: int) -> Column:
    """A literal of the unsigned ``value`` as BIGINT bits."""
    return F.lit(to_bits(value)).cast("bigint")


def ukey(x: Column | str) -> Column:
    """BIGINT whose signed order is the unsigned order of ``x``; its own inverse."""
    return _col(x).bitwiseXOR(F.lit(MIN).cast("bigint"))


def u64(x: Column | str) -> Column:
    """The unsigned value as DECIMAL(20,0)."""
    x = _col(x).cast("bigint")
    wide = x.cast("decimal(20,0)") + F.when(x < 0, F.expr(_TWO64)).otherwise(F.expr("0BD"))
    return wide.cast("decimal(20,0)")


def u64_sum(x: Column | str, wrapping: bool = False) -> Column:
    """Sum of the unsigned values: exact DECIMAL(38,0), or its rest modulo 2^64 as BIGINT bits.

    Four 16-bit parts are summed in BIGINT, exact up to 2^47 rows a group, which is 3 PB of records, and much faster than decimals;
    null if no value is there.
    """
    x = _col(x).cast("bigint")
    parts = (F.sum(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("decimal(20,0)") for i in range(4))
    total = reduce(lambda a, b: a + b, (p * F.expr(f"{1 << 16 * i}BD") for i, p in enumerate(parts))).cast("decimal(38,0)")
    return wrap(total) if wrapping else total


def wrap(total: Column) -> Column:
    """A non-negative DECIMAL modulo 2^64 as BIGINT bits."""
    rest = (total % F.expr(_TWO64)).cast("decimal(20,0)")
    half = F.expr("9223372036854775808BD")
    return F.when(rest >= half, (rest - F.expr(_TWO64)).cast("bigint")).otherwise(rest.cast("bigint"))


def record_keys(*columns: str) -> list[Column]:
    """Sort keys of the unsigned lexicographic record order."""
    return [ukey(c) for c in columns or ("barcode", "umi", "index")]


def record_less(left: list[Column], right: list[Column]) -> Column:
    """Whether one record stands before another, field by field, unsigned."""
    pairs = list(zip(left, right))
    return reduce(
        lambda rest, p: (ukey(p[0]) < ukey(p[1])) | ((p[0] == p[1]) & rest), reversed(pairs), F.lit(False)
    )
