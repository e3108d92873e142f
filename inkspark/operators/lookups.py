"""Lookups of one record per key: defaults, overrides, scopes, and links that a flag switches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _record(records: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    return records.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), *(F.col(v).alias(f"__v{i}") for i, v in enumerate(values)))


def linked(rows: DataFrame, records: DataFrame, on: Sequence[Column | str], key: Sequence[str], take: dict[str, str], when: Column | None = None) -> DataFrame:
    """``rows`` with columns of the record whose ``key`` equals ``on``, null without one or where ``when`` does not hold."""
    table = _record(records, key, list(take.values()))
    same = when if when is not None else F.lit(True)
    for i, column in enumerate(on):
        same = same & ((F.col(column) if isinstance(column, str) else column) == F.col(f"__k{i}"))
    return rows.join(table, same, "left").select(*rows.columns, *(F.col(f"__v{i}").alias(name) for i, name in enumerate(take)))


def with_default(rows: DataFrame, records: DataFrame, on: Sequence[Column | str], key: Sequence[str], value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` of their record, or the default without a record or value."""
    return linked(rows, records, on, key, {value: value}).withColumn(value, F.coalesce(value, default))


def overridden(base: DataFrame, overrides: DataFrame, on: Sequence[Column | str], key: str, order: str, value: str, out: str, of: str) -> DataFrame:
    """``base`` with ``out``: the last listed override's ``value`` where there is one, else the column ``of``."""
    from .documents import newest

    last = newest(overrides, key, order, [value])
    return linked(base, last, on, [key], {"__over": value}).withColumn(out, F.coalesce("__over", of)).drop("__over")


def scoped(names: DataFrame, local: DataFrame, on: Sequence[Column | str], key: Sequence[str], value: str, of: str, out: str = "refers_to") -> DataFrame:
    """Names by scope: the sheet's own definition where there is one, else the workbook's; ``scope`` tells which."""
    found = linked(names, local, on, key, {"__local": value})
    return found.withColumn(out, F.coalesce("__local", of)).withColumn("scope", F.when(F.col("__local").isNull(), "workbook").otherwise("sheet")).drop("__local")


def gap_joined(runs: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, w: str, text: str, gap: float) -> DataFrame:
    """Texts of runs along a line, with a space where the next begins at least ``gap`` after the last has ended."""
    from .documents import joined_text

    over = Window.partitionBy(*keys).orderBy(*order)
    space = F.col(x) - F.lag(F.col(x) + F.col(w)).over(over) >= gap
    placed = runs.withColumn("__n", F.row_number().over(over)).withColumn("__piece", F.concat(F.when(space, " ").otherwise(""), F.col(text)))
    return joined_text(placed, keys, ["__n"], "__piece", "")


def byte_starts(runs: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, out: str = "start") -> DataFrame:
    """``runs`` with the number of UTF-8 bytes of the texts before each."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn(out, F.coalesce(F.sum(F.octet_length(text).cast("long")).over(over), F.lit(0)))
