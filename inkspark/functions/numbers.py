"""Built-in number formats and serial dates as column expressions, for values of up to 15 digits.

Rounding is half away from zero on the binary number: ``floor(x * 10 ** d + 0.5) / 10 ** d``.  Serial dates follow the 1900
system with its 29 February 1900 (serial 60); a negative serial has no date.  Custom codes, and the long numbers that the
formats cut instead of rounding, are :mod:`inkspark.functions.numfmt`'s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def rounded(x: Column, digits: int) -> Column:
    p = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def fixed(x: Column, digits: int, group: bool = False) -> Column:
    """Fixed decimals of a number, with thousands separators if asked for."""
    text = F.format_number(F.abs(rounded(x, digits)), digits)
    text = text if group else F.translate(text, ",", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), text)


def percent(x: Column, digits: int) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))


def accounting(x: Column, digits: int) -> Column:
    """Negative numbers in parentheses, others with a trailing space."""
    body = F.format_number(F.abs(rounded(x, digits)), digits)
    return F.when(x < 0, F.concat(F.lit("("), body, F.lit(")"))).otherwise(F.concat(body, F.lit(" ")))


def serial_of(ts: Column) -> Column:
    """The serial of a timestamp (1900 system): days since 1899-12-31, one more after 28 February 1900."""
    day = F.to_date(ts)
    days = F.datediff(day, F.lit("1899-12-31").cast("date"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (days + F.when(day > F.lit("1900-02-28").cast("date"), 1).otherwise(0)) + seconds / F.lit(86400.0)


def _parts(serial: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a serial of 62 or more, by the day before 1899-12-31."""
    day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial + 1e-9).cast("int"))
    return F.year(day), F.month(day), F.day(day)


def date_text(serial: Column, fmt: int) -> Column:
    """Formats 14, 15, 16, 17 and 22 of serials from 62 on."""
    y, m, d = _parts(serial)
    yy = F.lpad(F.pmod(y, F.lit(100)).cast("string"), 2, "0")
    name = F.element_at(F.array(*(F.lit(x) for x in _MONTHS)), m)
    minutes = F.pmod(F.floor((serial - F.floor(serial)) * 1440 + 1e-6), F.lit(1440)).cast("int")
    clock = F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return {
        14: F.concat_ws("-", two(m), two(d), yy),
        15: F.concat_ws("-", d.cast("string"), name, yy),
        16: F.concat_ws("-", d.cast("string"), name),
        17: F.concat_ws("-", name, yy),
        22: F.concat(m.cast("string"), F.lit("/"), d.cast("string"), F.lit("/"), yy, F.lit(" "), clock),
    }[fmt]
