"""Queries through whole files: rows are written as documents by the sinks, and read back by the sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formula, numfmt
from ..operators import documents as D
from ..operators import layout
from ..session import ship
from ..sinks import packages
from ..sinks import pdf as pdf_sink
from ..sources import readers
from .cells import _fixed
from .text import read


def as_files(rows: DataFrame, name: str, value: str, build: Callable[[object], bytes]) -> DataFrame:
    """(path, content) with one file per row, built from ``value``.

    The rows are dealt out by name first: a table in few splits would leave most cores idle, and files are work for Python."""
    spark = ship(rows.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([build(v) for v in part.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return rows.select(F.col(name).cast("string").alias("path"), F.col(value)).repartition(parts, "path").mapInArrow(run, "path string, content binary")


def _zip(text: str | None) -> bytes:
    return packages.zip_bytes([("text.txt", (text or "").encode()), ("empty", b"")], frozenset({"empty"}))


def _docx(text: str | None) -> bytes:
    builder = packages.DocxBuilder("A text")
    for line in (text or "").split("\n"):
        builder.paragraph(line)
    return builder.to_bytes()


def _pdf(text: str | None) -> bytes:
    return pdf_sink.flow([(line, 10.0) for line in (text or "").split("\n")])


def _workbook(values: list) -> bytes:
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = "".join(f'<row r="{k + 2}"><c r="B{k + 2}" s="1"><v>{v!r}</v></c><c r="D{k + 2}" s="2"><v>{v!r}</v></c></row>' for k, v in enumerate(values))
    return packages.zip_bytes([
        ("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>'.encode()),
        ("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="p"><Relationship Id="r1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'.encode()),
        ("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>".encode()),
        ("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="4"/><xf numFmtId="37"/></cellXfs></styleSheet>'.encode()),
    ])


def _md5(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def zip_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an archive per document."""
    files = as_files(read(spark, d, "documents"), "doc_id", "text", _zip)
    rows = readers.parse_rows(files, "zip", "entries")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "name", "method", "usize", F.md5("content").alias("md5"))


def docx_flat_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a word-processing file and its flat text."""
    files = as_files(read(spark, d, "documents"), "doc_id", "text", _docx)
    runs = readers.parse_rows(files, "docx", "paragraph_runs").filter(F.col("part") == "word/document.xml")
    every = runs.select("path", "block_path", "run_idx", "kid_kind", "text", "del_text").repartition("path")  # serves both sums of the text
    flat = D.flat_text(every, ["path"], ["block_path"], ["run_idx"], "kid_kind", "text", "del_text")
    return flat.select(F.col("path").cast("long").alias("doc_id"), _md5(F.col("text")).alias("md5"))


def pdf_words(spark: SparkSession, d: str) -> DataFrame:
    """Every document set as pages and its words read back in order."""
    files = as_files(read(spark, d, "documents"), "doc_id", "text", _pdf)
    runs = readers.parse_rows(files, "pdf", "runs")
    words = D.joined_text(runs, ["path"], ["page", "run_idx"], "text", " ")
    return words.select(F.col("path").cast("long").alias("doc_id"), _md5(F.col("text")).alias("md5"))


def xlsx_display(spark: SparkSession, d: str) -> DataFrame:
    """Balances of each nation's customers in a workbook, as its cells show them."""
    groups = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("rows"))
    files = as_files(groups.select("c_nationkey", F.col("rows.c_acctbal").alias("values")), "c_nationkey", "values", _workbook)
    cells = readers.parse_rows(files, "xlsx", "cells")
    formats = readers.parse_rows(files, "xlsx", "xfs").select("path", F.col("style_idx").alias("xf"), "num_fmt_id")
    codes = spark.createDataFrame(list(numfmt.BUILTIN.items()), "id int, code string")
    styled = cells.join(formats, (cells.path == formats.path) & (cells.style_idx == formats.xf)).select(cells.path, "row", "col", "raw", "num_fmt_id")
    shown = styled.join(F.broadcast(codes), styled.num_fmt_id == codes.id, "left").withColumn("shown", numfmt.display_column(F.col("raw"), F.col("code")))
    return shown.select(F.col("path").cast("long").alias("c_nationkey"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "shown")


def formula_render(spark: SparkSession, d: str) -> DataFrame:
    """Formulas over cells of parts, rendered."""
    ship(spark)
    text = F.format_string("=SUM('My Sheet'!$A$%d:B%d) + -%d%%", F.col("p_size"), F.col("p_size") + 3, F.col("p_size"))
    return read(spark, d, "part").select("p_partkey", formula.rendered_column(text).alias("rendered"))


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as runs of text on pages (an order a page), folded into lines and blocks."""
    rows = read(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.lit(0).alias("page"),
        F.row_number().over(_per_order()).alias("run_idx"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_linenumber") * 40.0).alias("x"), (700.0 - F.floor(F.col("l_quantity") / 10) * 14).alias("y"), F.lit(12.0).alias("size"), F.lit(20.0).alias("w"), F.lit(False).alias("vert"),
    )
    return layout.lines_of(rows).select("path", "line", "block", "text")


def layout_tables(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as a table on a page, found again."""
    rows = read(spark, d, "nation").withColumn("n", F.row_number().over(_per_region()))
    cells = rows.select("n_regionkey", "n", F.explode(F.array(F.struct(F.lit(50.0).alias("x"), F.col("n_name").alias("text")), F.struct(F.lit(250.0).alias("x"), F.col("n_nationkey").cast("string").alias("text")))).alias("c"))
    runs = cells.select(
        F.col("n_regionkey").cast("string").alias("path"), F.lit(0).alias("page"), (F.col("n") * 2 + (F.col("c.x") > 100).cast("int")).alias("run_idx"), "c.text", "c.x",
        (700.0 - F.col("n") * 20).alias("y"), F.lit(10.0).alias("size"), F.lit(60.0).alias("w"), F.lit(False).alias("vert"),
    )
    found = layout.tables_of(runs).select("path", F.posexplode("rows").alias("at", "cells"))
    return found.select(F.col("path").cast("long").alias("region"), F.col("at").cast("long").alias("at"), F.array_join("cells", "|").alias("cells"))


def _wrapped_runs(spark: SparkSession, d: str) -> DataFrame:
    """A page per region: a table whose first column wraps, body text, and a table of three columns."""
    rows = read(spark, d, "nation").withColumn("n", F.row_number().over(_per_region()))
    at = lambda x, y, text: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"), text.alias("text"))
    n, key = F.col("n"), F.col("n_nationkey").cast("string")
    placed = F.array(
        at(50, 700 - 30 * n, F.col("n_name")), at(250, 700 - 30 * n, key), at(50, 688 - 30 * n, F.concat(F.lit("sub"), n)), at(120, 500 - 20 * n, F.concat(F.lit("body "), n)),
        at(50, 300 - 20 * n, key), at(180, 300 - 20 * n, F.col("n_name")), at(320, 300 - 20 * n, F.concat(F.lit("c"), n)),
    )
    runs = rows.select(F.col("n_regionkey").cast("string").alias("path"), F.lit(0).alias("page"), F.explode(placed).alias("r")).select("path", "page", "r.*")
    order = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("y"), "x"))
    return runs.select("path", "page", order.alias("run_idx"), "text", "x", "y", F.lit(10.0).alias("size"), F.lit(40.0).alias("w"), F.lit(False).alias("vert"))


def layout_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Two tables on a page; lines on one edge are wrapped parts of the row above."""
    found = layout.tables_of(_wrapped_runs(spark, d)).select("path", "idx", F.posexplode("rows").alias("at", "cells"))
    return found.select(F.col("path").cast("long").alias("region"), F.col("idx").cast("long").alias("idx"), F.col("at").cast("long").alias("at"), F.array_join("cells", "|").alias("cells"))


def layout_sheet(spark: SparkSession, d: str) -> DataFrame:
    """What of those pages is not in tables, as rows with their kinds."""
    runs = _wrapped_runs(spark, d)
    found = layout.sheet_of(layout.lines_of(runs), layout.tables_of(runs))
    return found.select(F.col("path").cast("long").alias("region"), "kind", "text", "x", "y", "w", "h")


def _per_order():
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")


def _per_region():
    return Window.partitionBy("n_regionkey").orderBy("n_nationkey")


_ROWS = "SELECT c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS row FROM customer"
_MONEY = "CASE WHEN c_acctbal < 0 THEN '(' || {body} || ')' ELSE {body} || ' ' END".format(body=_fixed("c_acctbal", 0, True, False))

QUERIES = {f.__name__: f for f in (zip_entries, docx_flat_text, pdf_words, xlsx_display, formula_render, layout_lines, layout_tables, layout_wrapped, layout_sheet)}
ORACLES = {
    "zip_entries": """SELECT doc_id, 'text.txt' AS name, 'deflated' AS method, CAST(strlen(text) AS BIGINT) AS usize, md5(text) AS md5 FROM documents
        UNION ALL SELECT doc_id, 'empty', 'stored', 0, md5('') FROM documents""",
    "docx_flat_text": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "pdf_words": "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'))) AS md5 FROM documents",
    "xlsx_display": f"SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, row, 2::BIGINT AS col, {_fixed('c_acctbal', 2, True)} AS shown FROM ({_ROWS}) UNION ALL SELECT c_nationkey, row, 4, {_MONEY} FROM ({_ROWS})",
    "formula_render": "SELECT p_partkey, 'SUM(My Sheet!$A$' || p_size || ':B' || (p_size + 3) || ')+-' || p_size || '%' AS rendered FROM part",
    "layout_lines": """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS n, l_returnflag || l_linestatus AS t,
          l_linenumber * 40.0 AS x, 700.0 - floor(l_quantity / 10) * 14 AS y FROM lineitem),
        g AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY n)) > 6 THEN 1 ELSE 0 END AS new FROM r),
        l AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY n) AS line FROM g),
        p AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY l_orderkey, line ORDER BY x, n) - 20 >= 1.8 THEN ' ' ELSE '' END || t AS piece FROM l),
        j AS (SELECT l_orderkey, line, string_agg(piece, '' ORDER BY x, n) AS text, min(x) AS x, min(y) AS y FROM p GROUP BY 1, 2),
        b AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) <= 18 AND abs(x - lag(x) OVER w) <= 24 THEN 0 ELSE 1 END AS cut FROM j WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
        SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(line AS INTEGER) AS line, CAST(sum(cut) OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS INTEGER) AS block, text FROM b""",
    "layout_wrapped": """WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, n_name, n_nationkey FROM nation)
        SELECT region, 0::BIGINT AS idx, n - 1 AS at, n_name || chr(10) || 'sub' || n || '|' || n_nationkey AS cells FROM n UNION ALL SELECT region, 1, n - 1, n_nationkey || '|' || n_name || '|c' || n FROM n""",
    "layout_sheet": """SELECT CAST(n_regionkey AS BIGINT) AS region, 'paragraph' AS kind, 'body ' || row_number() OVER w AS text, 120::DOUBLE AS x, (500 - 20 * row_number() OVER w)::DOUBLE AS y, 0::DOUBLE AS w, 0::DOUBLE AS h
        FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)""",
    "layout_tables": "SELECT CAST(n_regionkey AS BIGINT) AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS at, n_name || '|' || n_nationkey AS cells FROM nation",
}
