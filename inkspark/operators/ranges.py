"""Range lookups without nested loops.

A range ``lo..hi`` is listed under every block of ``width`` numbers that it touches, so that a point meets its candidates
by an equi-join on the block; the range itself is then tested.  Ties go to the first or the last range listed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_blocks(ranges: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """``ranges`` with one row per block touched (``__block``); a range with ``hi < lo`` touches none."""
    spread = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    return ranges.filter(F.col(lo) <= F.col(hi)).withColumn("__block", F.explode(spread))


def first_range(
    points: DataFrame, ranges: DataFrame, key: list[str], at: str, lo: str, hi: str, order: str, take: list[str], width: int = 1024, last: bool = False, also: Column | None = None
) -> DataFrame:
    """``points`` left-joined to the first (or last) listed range that holds them.

    The answer depends on the columns ``key`` alone, so only different keys meet ranges; ``also`` is a further condition on
    a key and a range.  ``min_by`` or ``max_by`` reduces each key to one row before the points take it up.
    """
    listed = in_blocks(ranges, lo, hi, width)
    placed = points.select(*dict.fromkeys([*key, at])).distinct().withColumn("__block", F.floor(F.col(at) / width))
    hit = (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    met = placed.join(listed, "__block").filter(hit if also is None else hit & also)
    pick = (F.max_by if last else F.min_by)(F.struct(*take), F.col(order))
    best = met.groupBy(*key).agg(pick.alias("__best"))
    return points.join(best, key, "left").select(*points.columns, *(F.col(f"__best.{c}").alias(c) for c in take))


#: Rows that a part of an as-of lookup may hold, about.
PART_ROWS = 500_000
_SHARES = 1024


def _part(x: Column, cuts: list[int]) -> Column:
    """How many of the ordered ``cuts`` are not above ``x``: first among every n-th of them, then among the n that follow."""
    if not cuts:
        return F.lit(0)
    n = math.isqrt(len(cuts) - 1) + 1
    every, heads = (F.array(*(F.lit(c).cast("long") for c in some)) for some in (cuts, cuts[::n]))
    upto = lambda some: F.size(F.filter(some, lambda c: c <= x))
    block = (upto(heads) - 1) * n
    return F.when(x < F.lit(cuts[0]), 0).otherwise(block + upto(F.slice(every, block + 1, F.lit(n)))).cast("int")


def as_of(points: DataFrame, starts: DataFrame, at: str, start: str, order: str, take: list[str], parts: int = 64) -> DataFrame:
    """``points`` with the columns of the greatest ``start`` that is not above ``at``; of equal starts the last listed.

    At most ``parts`` different starts cut the line of numbers themselves: a point's part names its start, and points meet
    the broadcast starts where they lie.  Else the line is cut at quantiles of starts and different points together, which
    are read first, so a number's part never depends on how rows were dealt out, and no part holds many more rows than
    another, wherever the points crowd; there are ``parts`` of them or more, by the number of rows.  Inside a part, starts
    and points are merged in one sort and each point takes the last start before it; what a part takes over from those
    before is one row per part.
    """
    kept = starts.groupBy(F.col(start).cast("long").alias("__at")).agg(F.max_by(F.struct(*take), F.col(order)).alias("__take"))
    kept = kept.filter("__at IS NOT NULL")
    x = F.col(at).cast("long")
    few = kept.select("__at").limit(parts + 1).collect()
    if len(few) <= parts:
        cuts = sorted(r[0] for r in few)
        ends = kept.select(_part(F.col("__at"), cuts).alias("__part"), "__take")
        joined = points.withColumn("__part", _part(x, cuts)).join(F.broadcast(ends), "__part", "left")
        return joined.select(*points.columns, *(F.col(f"__take.{c}").alias(c) for c in take))
    kind = kept.schema["__take"].dataType
    asked = points.filter(F.col(at).isNotNull()).select(x.alias("__at")).distinct().select("__at", F.lit(None).cast(kind).alias("__take"), F.lit(1).alias("__point"))
    both = kept.select("__at", "__take", F.lit(0).alias("__point")).unionByName(asked)
    shares = ", ".join(f"{k / _SHARES}D" for k in range(1, _SHARES))
    n, quantiles = both.agg(F.count(F.lit(1)), F.expr(f"percentile_approx(__at, array({shares}), {10 * _SHARES})")).first()
    parts = min(max(parts, -(-n // PART_ROWS)), _SHARES)
    cuts = sorted({int(quantiles[k * _SHARES // parts - 1]) for k in range(1, parts)})
    both = both.withColumn("__part", _part(F.col("__at"), cuts))
    last = F.last("__take", ignorenulls=True)
    inside = Window.partitionBy("__part").orderBy("__at", "__point")
    ends = kept.groupBy(_part(F.col("__at"), cuts).alias("__part")).agg(F.max_by("__take", "__at").alias("__end"))  # at most ``parts`` rows
    every = points.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__part")).join(F.broadcast(ends), "__part", "left")
    before = every.withColumn("__before", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    found = both.withColumn("__here", last.over(inside)).filter("__point = 1").join(F.broadcast(before.select("__part", "__before")), "__part")
    found = found.select("__at", F.coalesce("__here", "__before").alias("__take"))
    joined = points.join(found, x == F.col("__at"), "left")
    return joined.select(*points.columns, *(F.col(f"__take.{c}").alias(c) for c in take))
