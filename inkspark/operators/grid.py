"""Sparse cells to dense rows, and dictionaries of shared strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_rows(cells: DataFrame, row: str, col: str, text: str, *keys: str) -> DataFrame:
    """One row per row number with ``cells``, an array from column 1 to the last cell; gaps are empty strings.

    A cell stored twice shows its first text in order; blank cells take no place.
    """
    group = [*keys, row]
    held = cells.filter(F.col(text).isNotNull()).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(col).cast("int").alias("c"), F.col(text).alias("t")))).alias("a"), F.max(col).cast("int").alias("w")
    )
    first = F.filter("a", lambda e, i: (i == 0) | (F.get("a", i - 1)["c"] != e["c"]))
    held = held.select(*group, "w", F.map_from_entries(first).alias("m"))
    return held.select(*group, F.transform(F.sequence(F.lit(1), F.col("w")), lambda k: F.coalesce(F.col("m")[k], F.lit(""))).alias("cells"))


def dictionary(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """(idx, value): the distinct values in order, from 0.

    Values are cut into ranges at values of least hash (at most 16 for each range are read), numbered in each range, and moved
    on by what the ranges before hold, so no task sorts all of them."""
    distinct = df.select(F.col(value).alias("value")).distinct()
    some = sorted(r["value"] for r in distinct.filter("value IS NOT NULL").orderBy(F.xxhash64("value"), "value").limit(16 * parts).collect())
    cuts = some[8::16]
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<string>")
    placed = distinct.withColumn("__part", F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("value"))), F.lit(-1)))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.select("__part", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("value"))
    return placed.withColumn("__i", inside).join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__i") - 1).alias("idx"), "value")


def resolve_shared(cells: DataFrame, strings: DataFrame, idx: str, out: str) -> DataFrame:
    """``cells`` with the string of each index; an index out of range is an error.  Spark picks the join by the sizes."""
    table = strings.select(F.col("idx").alias("__idx"), F.col("value").alias("__value"))
    joined = cells.join(table, F.col(idx) == F.col("__idx"), "left")
    missing = F.col("__value").isNull() & F.col(idx).isNotNull()
    text = F.when(missing, F.raise_error(F.concat(F.lit("shared string index out of range: "), F.col(idx).cast("string")))).otherwise(F.col("__value"))
    return joined.select(*cells.columns, text.alias(out))
