"""Sequences of bases as 2-bit values; an extension, as the format doesn't say in which order bases fill a word."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of the bases.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
_BASES = "ACGT"


def encode_bases(sequence: Column, first_base: str) -> Column:
    """BIGINT bits of up to 32 bases; null for null, longer ones and other letters. ``first_base`` is ``low`` or ``high``."""
    _check(first_base)
    digits = F.translate(F.reverse(sequence) if first_base == "low" else sequence, _BASES, "0123")
    value = F.aggregate(
        F.split(digits, ""),
        F.lit(0).cast("bigint"),
        lambda total, d: F.shiftleft(total, 2).bitwiseOR(F.coalesce(d.try_cast("bigint"), F.lit(0).cast("bigint"))),
    )
    return F.when(sequence.rlike("^[ACGT]{0,32}$"), value)


def decode_bases(bits: Column, length: Column, first_base: str) -> Column:
    """The bases of a value; bits beyond ``length``, 0 to 32, are left out."""
    _check(first_base)
    at = lambda i: F.substring(F.lit(_BASES), (F.shiftrightunsigned(bits, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    low_first = F.concat(*(F.when(F.lit(i) < length, at(i)).otherwise("") for i in range(32)))
    return low_first if first_base == "low" else F.reverse(low_first)


def _check(first_base: str) -> None:
    if first_base not in ("low", "high"):
        raise ValueError("first_base is low or high")
