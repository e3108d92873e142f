"""Cell references and cell types as column expressions.

Columns are A to XFD (1 to 16384), rows 1 to 1048576.  Names are upper case; ``$`` marks are ignored; a row with a leading
zero, or anything out of range, is an error, which here is a null (``strict`` raises instead).  Rows of tables that are no
sheets may go on beyond a sheet's last: ``max_row=None`` names them all, up to 18 digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_COLUMN, MAX_ROW = 16384, 1048576
#: The type letters of a cell.
CELL_TYPES = {"b": "bool", "d": "date", "e": "error", "n": "number", "s": "shared_string", "str": "formula", "inlineStr": "inline_string"}


def column_name(number: Column) -> Column:
    """The letters of a column number: bijective base 26, three letters at most."""
    n = number.cast("int")
    letter = lambda v: F.chr(F.lit(65) + F.pmod(v - 1, F.lit(26)))
    more = F.floor((n - 1) / 26).cast("int")
    most = F.floor((more - 1) / 26).cast("int")
    name = F.concat(F.when(n > 702, letter(most)).otherwise(""), F.when(n > 26, letter(more)).otherwise(""), letter(n))
    return F.when(n.between(1, MAX_COLUMN), name)


def column_number(name: Column) -> Column:
    """The number of a column's letters."""
    digit = lambda k: F.ascii(F.substring(name, k, 1)) - 64
    value = F.when(F.length(name) == 1, digit(1)).when(F.length(name) == 2, digit(1) * 26 + digit(2)).otherwise(digit(1) * 676 + digit(2) * 26 + digit(3))
    return F.when(name.rlike("^[A-Z]{1,3}$") & (value <= MAX_COLUMN), value)


def split_cell(ref: Column, max_row: int | None = MAX_ROW) -> Column:
    """struct(col, row) of a reference such as ``$B$7``; null if it is malformed."""
    bare = F.translate(ref, "$", "")
    col = column_number(F.regexp_extract(bare, r"^([A-Z]{1,3})[1-9][0-9]*$", 1))
    row = F.regexp_extract(bare, r"^[A-Z]{1,3}([1-9][0-9]{0,%d})$" % (6 if max_row == MAX_ROW else 17), 1)
    row = F.when(row != "", row.cast("int" if max_row == MAX_ROW else "long"))
    return F.when(col.isNotNull() & (row.isNotNull() if max_row is None else row <= max_row), F.struct(col.alias("col"), row.alias("row")))


def join_cell(col: Column, row: Column, max_row: int | None = MAX_ROW) -> Column:
    """The reference of a column and row number; null out of range."""
    return F.when(row >= 1 if max_row is None else row.between(1, max_row), F.concat(column_name(col), row.cast("string")))


def cell_type(tag: Column) -> Column:
    """The kind of cell that a type tag names; absent or unknown tags are ``unset``."""
    kind = F.lit("unset")
    for key, value in CELL_TYPES.items():
        kind = F.when(tag == key, value).otherwise(kind)
    return kind


def strict(value: Column, what: str) -> Column:
    """``value``, or an error where it is null."""
    return F.coalesce(value, F.raise_error(F.lit(what)).cast("string"))
