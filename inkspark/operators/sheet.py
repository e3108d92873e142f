"""Spreadsheet operators over the tables of :mod:`inkspark.sources.xlsx` (with ``path`` as every reader adds it)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import ranges
from .lookups import linked


def cell_texts(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """``cells`` with ``text``: shared strings by their index (out of range is an error), booleans as TRUE and FALSE, others
    as stored."""
    table = strings.select(F.col("path").alias("__p"), F.col("idx").alias("__i"), F.col("text").alias("__t"))
    shared = (F.col("cell_type") == "shared_string") & (F.trim("raw") != "")
    index = F.when(shared, F.col("raw").cast("int"))
    joined = cells.withColumn("__k", index).join(table, (F.col("path") == F.col("__p")) & (F.col("__k") == F.col("__i")), "left")
    missing = F.col("__k").isNotNull() & F.col("__t").isNull()
    error = F.raise_error(F.concat(F.lit("shared string index out of range: "), F.col("raw"))).cast("string")
    text = (
        F.when(missing, error).when(shared, F.col("__t")).when(F.col("cell_type") == "shared_string", "")
        .when(F.col("cell_type") == "inline_string", F.coalesce("inline_text", "raw"))
        .when((F.col("cell_type") == "bool") & (F.col("raw") == "1"), "TRUE").when((F.col("cell_type") == "bool") & (F.col("raw") == "0"), "FALSE").otherwise(F.col("raw"))
    )
    return joined.select(*cells.columns, text.alias("text"))


def display(cells: DataFrame, xfs: DataFrame, num_fmts: DataFrame, sheets: DataFrame) -> DataFrame:
    """``cells`` (with ``text``) with ``shown``: numbers and dates under their format, other kinds as they are.

    Format codes are a few per workbook, so they are joined on and compiled once per worker.
    """
    from ..functions import numfmt

    ship(cells.sparkSession)
    formats = xfs.join(num_fmts.withColumnRenamed("path", "__q"), (F.col("path") == F.col("__q")) & (xfs.num_fmt_id == num_fmts.num_fmt_id), "left").select(
        xfs.path.alias("__p"), F.col("style_idx").alias("__s"), xfs.num_fmt_id.alias("__id"), F.col("code").alias("__code")
    )
    base = sheets.groupBy(F.col("path").alias("__b")).agg(F.max("date1904").alias("__1904"))

    @F.pandas_udf("string")
    def shown(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, kinds, ids, codes, old in batches:
            out = []
            for text, kind, fmt, code, late in zip(texts, kinds, ids, codes, old, strict=True):
                if text is None or pd.isna(fmt) or kind not in ("number", "unset", "date"):
                    out.append(text)
                    continue
                serial = numfmt.iso_to_serial(text) if kind == "date" else None
                text = numfmt.significant(serial, 15) if serial is not None else text
                out.append(numfmt.display_id(text, int(fmt), {int(fmt): code} if code else None, "number", bool(late)))
            yield pd.Series(out)

    joined = cells.join(formats, (cells.path == F.col("__p")) & (cells.style_idx == F.col("__s")) & (cells.style_idx > 0), "left").join(base, cells.path == F.col("__b"), "left")
    return joined.select(*(cells[c] for c in cells.columns), shown("text", "cell_type", "__id", "__code", F.coalesce("__1904", F.lit(False))).alias("shown"))


def merge_anchors(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``cells`` with ``anchor_row`` and ``anchor_col`` of the first listed merge over each, null outside of merges."""
    key = ["path", "sheet", "row", "col"]
    boxes = merges.select(
        F.col("path").alias("__p"), F.col("sheet").alias("__s"), F.col("ord").alias("__o"), F.col("first_row").alias("__r1"), F.col("last_row").alias("__r2"), F.col("first_col").alias("__c1"),
        F.col("last_col").alias("__c2"), "anchor_row", "anchor_col",
    )
    inside = (F.col("path") == F.col("__p")) & (F.col("sheet") == F.col("__s")) & F.col("col").between(F.col("__c1"), F.col("__c2"))
    return ranges.first_range(cells, boxes, key, "row", "__r1", "__r2", "__o", ["anchor_row", "anchor_col"], also=inside)


def column_widths(columns: DataFrame, cols: DataFrame) -> DataFrame:
    """``columns`` (path, sheet, col) with the width of the last listed range that holds each, -1 without one."""
    listed = cols.filter("has_width").select(F.col("path").alias("__p"), F.col("sheet").alias("__s"), F.col("ord").alias("__o"), F.col("min").alias("__lo"), F.col("max").alias("__hi"), "width")
    same = (F.col("path") == F.col("__p")) & (F.col("sheet") == F.col("__s"))
    found = ranges.first_range(columns, listed, ["path", "sheet", "col"], "col", "__lo", "__hi", "__o", ["width"], last=True, also=same)
    return found.withColumn("width", F.coalesce("width", F.lit(-1.0)))


def formulas(cells: DataFrame) -> DataFrame:
    """Cells with a formula and its ``formula`` text: shared ones as they read in each cell, from the first cell (by row,
    then as stored) of their index that has a range; without one the text is empty."""
    from ..functions import formula as fx

    ship(cells.sparkSession)
    first = Window.partitionBy("path", "sheet", "f_si").orderBy("row", "file_ord")
    anchors = cells.filter("f_type = 'shared' AND f_ref <> ''").withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(
        F.col("path").alias("__p"), F.col("sheet").alias("__s"), F.col("f_si").alias("__i"), F.col("f_content").alias("__f"), F.col("row").alias("__r"), F.col("col").alias("__c")
    )

    @F.pandas_udf("string")
    def moved(texts: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fx.expand_shared(t, int(r), int(c)) for t, r, c in zip(texts, rows, cols, strict=True)])

    shared = cells.filter("has_formula AND f_type = 'shared'")
    joined = shared.join(anchors, (F.col("path") == F.col("__p")) & (F.col("sheet") == F.col("__s")) & (F.col("f_si") == F.col("__i")), "left")
    expanded = joined.select(*shared.columns, F.coalesce(moved("__f", F.coalesce(F.col("row") - F.col("__r"), F.lit(0)), F.coalesce(F.col("col") - F.col("__c"), F.lit(0))), F.lit("")).alias("formula"))
    return cells.filter("has_formula AND (f_type IS NULL OR f_type <> 'shared')").withColumn("formula", F.col("f_content")).unionByName(expanded)


def styles(cells: DataFrame, xfs: DataFrame, fonts: DataFrame, fills: DataFrame) -> DataFrame:
    """``cells`` with font and fill of their format, each only where the format applies it; what is missing is null."""
    xf = {"__font": "font_id", "__fill": "fill_id", "__use_font": "apply_font", "__use_fill": "apply_fill"}
    rows = linked(cells, xfs, ["path", "style_idx"], ["path", "style_idx"], xf)
    rows = linked(rows, fonts, ["path", "__font"], ["path", "font_id"], {"font_name": "name", "font_size": "size", "bold": "bold", "italic": "italic", "font_color": "color"}, F.col("__use_font"))
    return linked(rows, fills, ["path", "__fill"], ["path", "fill_id"], {"pattern": "pattern", "fill_color": "fg"}, F.col("__use_fill")).drop(*xf)


def workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the workbooks under a path by name, each parsed when it is used."""
    from ..sources import readers

    return {table: readers.read_table(spark, path, "xlsx", table) for table in readers.FORMATS["xlsx"][0]}
