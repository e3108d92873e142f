"""Cross-site line removal (DataFrame functions only).

A line's key is 128 bits of hash of its text without outer white space.  Per key, HyperLogLog sketches of the sites that
hold it are built by every task and merged by aggregation; keys whose estimate is too near the threshold to be sure get
an exact distinct count.  A line on ``min_sites`` sites or more stays only where it comes first (smallest id, then
position); its other occurrences go.  Every line that is not blank counts.  Lines of fewer than ``min_words`` words recur
by chance, so they must stand on more sites: ``short_sites`` more for each word that is missing.

Defined cases: a null text stays null and has no lines; a null site is a site of its own; rows equal in id and text are
treated alike, so a repeated row keeps what its twin keeps; a text without removed lines is returned as it was; an empty
table gives an empty result; lines and texts of any length are taken whole; other columns pass through unless their names begin
with two underscores.  A line that holds a great share of all lines is met in no single task: its key is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, join_spread, release, staged

_BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class LineDedupParams:
    min_sites: int = 3
    min_words: int = 5
    short_sites: int = 2  # more sites for each word below ``min_words``
    lg_k: int = 12  # of the sketches; their standard error is about 1.04 / sqrt(2 ** lg_k)
    doubt: float = 0.1  # share of the threshold within which an estimate is not trusted


def _line_rows(docs: DataFrame, id_col: str, text: str, site: str, params: LineDedupParams) -> DataFrame:
    """(__id, __k, __pos, __h1, __h2, __site, __need) of every line that is not blank; ``__need`` sites are enough for it."""
    rows = docs.select(
        F.col(id_col).alias("__id"), F.xxhash64(text).alias("__k"), F.xxhash64(F.coalesce(F.col(site), F.lit("\0null"))).alias("__site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("__pos", "__line"),
    )
    line = F.btrim(F.col("__line"), F.lit(_BLANK))
    short = params.min_words - F.size(F.split(line, r"[\x20\x09-\x0D]+", max(1, params.min_words)))
    need = (params.min_sites + params.short_sites * F.greatest(short, F.lit(0))).cast("int")
    rows = rows.filter(line != "")
    return rows.select("__id", "__k", "__pos", F.xxhash64(line).alias("__h1"), F.xxhash64(line, F.lit(1)).alias("__h2"), "__site", need.alias("__need"))


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", params: LineDedupParams = LineDedupParams()) -> tuple[DataFrame, DataFrame]:
    """The rows of lines on enough sites, and per such key its first occurrence (``__first``) and ``__sites``."""
    key = ["__h1", "__h2"]
    rows = staged(_line_rows(docs, id_col, text, site, params), "lines")
    often = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("__site").alias("a"), F.max("__site").alias("b"), F.max("__need").alias("need"))
    often = cut(often.filter((F.col("n") >= F.col("need")) & ((F.col("a") != F.col("b")) | F.lit(params.min_sites <= 1))).select(*key, "n"))
    every, rows = rows, staged(join_spread(rows, often, key, "n", rows.count()), "often")
    release(every)
    sketch = rows.groupBy(*key).agg(
        F.hll_sketch_agg("__site", params.lg_k).alias("s"), F.min(F.struct("__id", "__k", "__pos")).alias("__first"), F.max("__need").alias("__need"), F.count(F.lit(1)).alias("n")
    )
    found = staged(sketch.select(*key, F.hll_sketch_estimate("s").alias("__sites"), "__first", "__need", "n"), "sketches")
    low, high = F.col("__need") * (1 - params.doubt) - 1, F.col("__need") * (1 + params.doubt) + 1
    doubtful = found.filter((F.col("__sites") >= low) & (F.col("__sites") <= high))
    pairs = join_spread(rows, doubtful.select(*key, "n"), key, "n", rows.count()).groupBy(*key, "__site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("__exact"))
    sure = found.filter(F.col("__sites") > high).select(*key, "__first", "__sites", "n")
    near = doubtful.join(exact, key).filter(F.col("__exact") >= F.col("__need")).select(*key, "__first", F.col("__exact").alias("__sites"), "n")
    return rows, cut(sure.unionByName(near))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """``docs`` with the text of each row less its removed lines, and ``__removed``, their number."""
    rows, spread = spread_lines(docs, id_col, text, site, params)
    here = F.struct("__id", "__k", "__pos")
    gone = join_spread(rows, spread, ["__h1", "__h2"], "n", rows.count()).filter(here != F.col("__first"))
    gone = gone.groupBy("__id", "__k").agg(F.collect_set("__pos").alias("__gone")).withColumnsRenamed({"__id": "__i", "__k": "__j"})
    named = docs.withColumn("__k", F.xxhash64(text))
    both = named.join(gone, F.col(id_col).eqNullSafe(F.col("__i")) & (F.col("__k") == F.col("__j")), "left")
    left = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains("__gone", i))
    clean: Column = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return both.select(
        *(clean.alias(c) if c == text else F.col(c) for c in docs.columns),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__removed"),
    )
