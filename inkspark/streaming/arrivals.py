"""Documents as they arrive: a stream of files through the same parsers, and running counts with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import parse_rows

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, kind: str, table: str, mode: str = "PERMISSIVE", pattern: str = "*", files_per_batch: int = 1000, **options: str) -> DataFrame:
    """Rows of one table of every new file in a folder; a broken file gives a row with ``_error``."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return parse_rows(files, kind, table, mode, **options)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and key; events later than ``late`` are left out, so state stays bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
