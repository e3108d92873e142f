"""Readers: any files that Spark can list, parsed once into fixed tables.

:func:`read_table` goes through ``binaryFile``, so every file system that Spark knows works and a file is a unit of work;
the parsers run in Arrow batches.  ``mode`` is FAILFAST (an error names the file) or PERMISSIVE (a row with ``_error``).
:func:`register` adds data sources ``inkspark_zip``, ``inkspark_xlsx``, ``inkspark_docx`` and ``inkspark_pdf`` for
``spark.read.format(..).option("table", ..)`` over mounted folders (a Python data source has no access to Spark's file
systems; for object stores use :func:`read_table`); the xlsx source takes filters on ``sheet``, and all take ``mode``.  zip, docx
and pdf can be written too (:mod:`inkspark.sinks.writers`).
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import StructType

from ..session import ship
from . import docx, pdf, xlsx
from .package import FormatError, entries

ZIP_TABLES = {"entries": "idx int, name string, method string, csize long, usize long, crc long, content binary"}


def _zip(data: bytes, **_: str) -> dict[str, list[tuple]]:
    return {"entries": entries(data)}


def _xlsx(data: bytes, sheet: str | None = None, **_: str) -> dict[str, list[tuple]]:
    return xlsx.parse(data, sheet)


def _docx(data: bytes, **_: str) -> dict[str, list[tuple]]:
    return docx.parse(data)


def _pdf(data: bytes, password: str = "", table: str = "", **_: str) -> dict[str, list[tuple]]:
    return pdf.parse(data, password, frozenset({table}) if table else None)


FORMATS: dict[str, tuple[dict[str, str], Callable[..., dict[str, list[tuple]]]]] = {
    "zip": (ZIP_TABLES, _zip), "xlsx": (xlsx.TABLES, _xlsx), "docx": (docx.TABLES, _docx), "pdf": (pdf.TABLES, _pdf),
}


def table_schema(kind: str, table: str) -> str:
    tables = FORMATS[kind][0]
    if table not in tables:
        raise FormatError(f"{kind} has no table {table!r}; it has {', '.join(tables)}")
    return "path string, " + tables[table]


def parse_rows(files: DataFrame, kind: str, table: str, mode: str = "FAILFAST", **options: str) -> DataFrame:
    """Rows of one table from (path, content) rows, such as those of ``binaryFile``, streaming or not."""
    ship(files.sparkSession)
    schema = table_schema(kind, table) + (", _error string" if mode == "PERMISSIVE" else "")
    spark_schema = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    width = len(spark_schema) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = FORMATS[kind][1]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path, rows = path.as_py(), []
                try:
                    found = parse(content.as_py(), table=table, **options)[table]
                    rows = [(path, *row, None) if mode == "PERMISSIVE" else (path, *row) for row in found]
                except FormatError as error:
                    if mode != "PERMISSIVE":
                        raise FormatError(f"{path}: {error}") from None
                    rows = [(path, *[None] * (width - 1), str(error))]
                for k in range(0, len(rows), 4096):
                    columns = list(zip(*rows[k : k + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(_plain(c, f.type), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, spark_schema)


def _plain(values: tuple, kind: pa.DataType) -> list:
    if pa.types.is_map(kind):
        return [None if v is None else list(v.items()) for v in values]
    if pa.types.is_floating(kind):
        return [None if v is None else float(v) for v in values]
    return list(values)


def read_table(spark: SparkSession, path: str, kind: str, table: str, mode: str = "FAILFAST", **options: str) -> DataFrame:
    """One table of all documents under a path (a file, a folder or a pattern)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_rows(files, kind, table, mode, **options)


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict[str, str], width: int):
        self.kind, self.options, self.width = kind, dict(options), width
        self.sheet: str | None = options.get("sheet")

    def pushFilters(self, filters):  # noqa: N802  the name that Spark calls
        for f in filters:
            if self.kind == "xlsx" and isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.sheet is None:
                self.sheet = f.value
            yield f  # Spark tests every row again

    def partitions(self):
        path = self.options.get("path", "")
        found = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_Part(p) for p in found if os.path.isfile(p)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            data = f.read()
        extra = {k: v for k, v in (("sheet", self.sheet), ("password", self.options.get("password"))) if v}
        table = self.options.get("table", next(iter(FORMATS[self.kind][0])))
        lenient = self.options.get("mode", "").upper() == "PERMISSIVE"
        try:
            found = FORMATS[self.kind][1](data, table=table, **extra)[table]
        except FormatError as error:
            if self.kind == "xlsx" and str(error).startswith("no sheet"):
                return
            if lenient:
                yield (partition.path, *[None] * (self.width - 2), str(error))
                return
            raise FormatError(f"{partition.path}: {error}") from None
        for row in found:
            yield (partition.path, *row, None) if lenient else (partition.path, *row)


class _Source(DataSource):
    kind = ""

    def schema(self) -> str:
        kept = ", _error string" if self.options.get("mode", "").upper() == "PERMISSIVE" else ""
        return table_schema(self.kind, self.options.get("table", next(iter(FORMATS[self.kind][0])))) + kept

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, self.options, len(schema))

    def writer(self, schema, overwrite: bool):
        from ..sinks.writers import NEEDED, FileWriter

        if self.kind not in NEEDED:
            raise FormatError(f"{self.kind} files cannot be written from rows")
        return FileWriter(self.kind, dict(self.options), schema.fieldNames(), overwrite)


class ZipSource(_Source):
    kind = "zip"

    @classmethod
    def name(cls) -> str:
        return "inkspark_zip"


class XlsxSource(_Source):
    kind = "xlsx"

    @classmethod
    def name(cls) -> str:
        return "inkspark_xlsx"


class DocxSource(_Source):
    kind = "docx"

    @classmethod
    def name(cls) -> str:
        return "inkspark_docx"


class PdfSource(_Source):
    kind = "pdf"

    @classmethod
    def name(cls) -> str:
        return "inkspark_pdf"


def register(spark: SparkSession) -> SparkSession:
    """Register the four data sources with a session."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZipSource, XlsxSource, DocxSource, PdfSource):
        spark.dataSource.register(source)
    return spark
