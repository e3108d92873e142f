"""Page label numerals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The subtractive numerals.
_ROMAN = [
    ("M", "MM", "MMM"),
    ("C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"),
    ("X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"),
    ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"),
]
LIMIT = 1024


def roman(n: Column) -> Column:
    """Upper-case roman numerals; longer than 1024 characters, or below 1: decimal digits."""
    digit = lambda unit, names: F.get(F.array(F.lit(""), *(F.lit(x) for x in names)), F.pmod(F.floor(n / unit), F.lit(10)).cast("int"))
    thousands = F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))
    text = F.concat(thousands, *(digit(u, names) for u, names in zip((100, 10, 1), _ROMAN[1:], strict=True)))
    return F.when((n < 1) | (n >= (LIMIT + 1) * 1000), n.cast("string")).otherwise(F.when(F.length(text) > LIMIT, n.cast("string")).otherwise(text))


def alpha(n: Column) -> Column:
    """A to Z, AA to AZ and on, for numbers up to that of seven letters; below 1: decimal digits."""
    steps = F.sequence(F.lit(1), F.lit(7))
    start = F.struct(n.cast("long").alias("m"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["m"] > 0, F.struct(F.floor((a["m"] - 1) / 26).cast("long").alias("m"), F.concat(F.chr(F.pmod(a["m"] - 1, F.lit(26)) + 65), a["s"]).alias("s"))).otherwise(a)
    return F.when(n < 1, n.cast("string")).otherwise(F.aggregate(steps, start, step, lambda a: a["s"]))


def label(style: Column, prefix: Column, n: Column) -> Column:
    """A whole label: prefix and numeral in one of the styles D, R, r, A, a; any other style has no numeral."""
    numeral = (
        F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", F.lower(roman(n)))
        .when(style == "A", alpha(n)).when(style == "a", F.lower(alpha(n))).otherwise("")
    )
    return F.concat(F.coalesce(prefix, F.lit("")), numeral)
