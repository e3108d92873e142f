import pytest

from inkspark.functions import numfmt as N

VALUES = "1 44927 44927.5 0.5 1234.567 -1234.567 0 0.333333 60 61 2.675".split()
#: What the built-in formats show for VALUES.
BUILTIN = {
    0: "1|44927|44927.5|0.5|1234.567|-1234.567|0|0.333333|60|61|2.675",
    1: "1|44927|44928|1|1235|-1235|0|0|60|61|3",
    4: "1.00|44,927.00|44,927.50|0.50|1,234.57|-1,234.57|0.00|0.33|60.00|61.00|2.68",
    9: "100%|4492700%|4492750%|50%|123457%|-123457%|0%|33%|6000%|6100%|268%",
    11: "1.00E+00|4.49E+04|4.49E+04|5.00E-01|1.23E+03|-1.23E+03|0.00E+00|3.33E-01|6.00E+01|6.10E+01|2.67E+00",
    13: "1      |44927      |44927  1/2 |0  1/2 |1234 55/97|-1234 55/97|0      |0  1/3 |60      |61      |2 27/40",
    14: "01-01-00|01-01-23|01-01-23|01-00-00|05-18-03|-1234.567|01-00-00|01-00-00|02-29-00|03-01-00|01-02-00",
    19: "12:00:00 AM|12:00:00 AM|12:00:00 PM|12:00:00 PM|1:36:29 PM|-1234.567|12:00:00 AM|8:00:00 AM|12:00:00 AM|12:00:00 AM|4:12:00 PM",
    22: "1/1/00 00:00|1/1/23 00:00|1/1/23 12:00|1/0/00 12:00|5/18/03 13:36|-1234.567|1/0/00 00:00|1/0/00 08:00|2/29/00 00:00|3/1/00 00:00|1/2/00 16:12",
    44: " $1.00 | $44,927.00 | $44,927.50 | $0.50 | $1,234.57 | $(1,234.57)| $0.00 | $0.33 | $60.00 | $61.00 | $2.68 ",
    46: "24:00:00|1078248:00:00|1078260:00:00|12:00:00|29629:36:29|-1234.567|0:00:00|8:00:00|1440:00:00|1464:00:00|64:12:00",
    47: "00:00.0|00:00.0|00:00.0|00:00.0|36:29.0|-1234.567|00:00.0|59:59.9|00:00.0|00:00.0|12:00.0",
    48: "1|44927|44927.5|0.5|1234.567|-1234.567|0|0.333333|60|61|2.675",
}
#: Own codes and values; what is expected follows from the meaning of the placeholders, sections and locales.
CUSTOM = [
    ("0.000", "2.5", "2.500"), ("#,##0.0", "98765.43", "98,765.4"), ("0.0%", "0.256", "25.6%"), ("0.0E+00", "52000", "5.2E+04"), ("[m]", "0.25", "360"), ("hh:mm:ss", "0.75", "18:00:00"),
    ("yyyy-mm-dd", "45292", "2024-01-01"), ("dddd", "45292", "Monday"), ("mmm d", "45350", "Feb 28"), ('0.0" kg";"minus "0.0" kg"', "-3.2", "minus 3.2 kg"), ('0.0" kg";"minus "0.0" kg"', "4", "4.0 kg"),
    ("0,", "81234", "81"), ('@" units"', "box", "box units"), ("# ?/?", "1.25", "1 1/4"), ("[$-40C]dddd", "45292", "lundi"),
    ("[$-407]mmmm", "45352", "März"), ("h AM/PM", "0.625", "3 PM"), ("000", "7", "007"), ("General", "12.5", "12.5"),
]


@pytest.mark.parametrize("fmt", BUILTIN)
def test_builtin_formats(fmt):
    assert "|".join(N.display_id(v, fmt) for v in VALUES) == BUILTIN[fmt]


@pytest.mark.parametrize(("code", "value", "want"), CUSTOM)
def test_custom_codes(code, value, want):
    assert N.display(value, code) == want


def test_1904_dates():
    assert [N.display(v, "yyyy-mm-dd", date1904=True) for v in ("366", "1827", "43830")] == ["1905-01-01", "1909-01-01", "2024-01-01"]


def test_iso_dates():
    assert N.iso_to_serial("2024-01-01T06:00:00Z") == 45292.25
    assert N.iso_to_serial("1900-01-31 00:00:00") == 31
    assert N.iso_to_serial("tomorrow") is None


def test_display_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("1.5", "0.00"), (None, "0"), ("x", "0")], "v string, c string")
    assert [r[0] for r in df.select(N.display_column(F.col("v"), F.col("c"))).collect()] == ["1.50", None, "x"]
