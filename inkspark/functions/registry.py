"""SQL names for the functions that SQL cannot state itself, and table functions over file contents.

``register(spark)`` adds ``ink_display(value, code)``, ``ink_formula(text)``, ``ink_shift_formula(text, rows, cols)``,
``ink_text_string(bytes)``, ``ink_docx_text(bytes)``, ``ink_pdf_text(bytes)`` and the table functions
``ink_zip_entries(bytes)`` and ``ink_pdf_runs(bytes)``, which join laterally.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources import docx, pdf
from ..sources.cos import text_string
from ..sources.package import entries
from . import formula, numfmt


def _mapped(function, kind: str):
    """A one-column Arrow function that keeps nulls."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return run


def _display(values: pd.Series, codes: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or c is None else numfmt.display(v, c) for v, c in zip(values, codes, strict=True)])


def _shift(values: pd.Series, rows: pd.Series, cols: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else formula.expand_shared(v, int(r), int(c)) for v, r, c in zip(values, rows, cols, strict=True)])


class ZipEntries:
    """Entries of an archive, one row each."""

    def eval(self, content: bytes):
        if content is not None:
            for _, name, method, csize, usize, crc, data in entries(bytes(content)):
                yield name, method, csize, usize, crc, data


class PdfRuns:
    """Text runs of a document, one row each."""

    def eval(self, content: bytes):
        if content is not None:
            for page, run, text, x, y, size, font, width, vertical in pdf.parse(bytes(content), tables=frozenset({"runs"}))["runs"]:
                yield page, run, text, float(x), float(y), float(size), font, float(width), vertical


def register(spark: SparkSession) -> SparkSession:
    """Add the functions to a session."""
    ship(spark)
    udf = spark.udf.register
    udf("ink_display", F.pandas_udf(_display, "string"))
    udf("ink_shift_formula", F.pandas_udf(_shift, "string"))
    udf("ink_formula", _mapped(lambda v: formula.render(formula.tokens(v)), "string"))
    udf("ink_text_string", _mapped(lambda v: text_string(bytes(v)), "string"))
    udf("ink_docx_text", _mapped(lambda v: docx.flat_text(bytes(v)), "string"))
    udf("ink_pdf_text", _mapped(lambda v: pdf.document_text(bytes(v)), "string"))
    spark.udtf.register("ink_zip_entries", F.udtf(ZipEntries, returnType="name string, method string, csize long, usize long, crc long, content binary"))
    spark.udtf.register("ink_pdf_runs", F.udtf(PdfRuns, returnType="page int, run int, text string, x double, y double, size double, font string, width double, vertical boolean"))
    return spark
