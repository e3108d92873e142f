"""Quality rules by robust multivariate outliers (DataFrame functions only).

Each document gets counts (:func:`base_counts`), the counts become a vector of transformed statistics
(:func:`statistics`), and per language and source a minimum-covariance-determinant estimate of centre and scatter
(:func:`mcd`) gives the Mahalanobis distance beyond which a document is rejected.

The estimate starts from three subsets (those nearest to the medians by the sum of squares, the greatest and the sum of
deviations in quartile ranges), takes a concentration step from each, goes on from the one of least determinant, and ends
when no step makes a determinant smaller (``max_steps`` at most).  Every scatter has the squares of the least deviations
in ``STATISTICS`` added to its diagonal.  A source's estimate is drawn towards its language's as by ``prior`` more documents
like it, a language's towards that of all documents; so every source has its own estimate, and one of few documents is
judged nearly by its language.  Distances are scaled so that their median and upper quartile are those of chi-square, their logs
being drawn towards the parent's in the same way; a quartile nearer to the median than chi-square's is not stretched.
Beyond chi-square's quantile ``tail`` a document is rejected.

Every statistic is a fixed-point integer, and every sum that the estimate needs is a sum of such integers, so the
verdicts do not depend on how the rows were dealt out.  State per group is bounded: sums, and quantiles of integers with
a bounded number of different values.

Defined cases: a null text counts as empty and fails the base rules; null language or source are groups like others;
texts of any length are counted whole; equal rows get equal verdicts; an empty table gives an empty result; of
the documents' columns only id, text, language and source are read, so other names cannot clash, and all columns pass through
:func:`quality_filter`.  Every row that passes the base rules has a distance, however small its group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, join_spread, let, staged

#: Statistics, and the deviation whose square is added to the variance of each (natural logs and square roots of shares).
STATISTICS = {"log_words": 0.7, "log_word_length": 0.06, "symbol_share": 0.05, "dup_lines": 0.4, "repeats": 0.3}
_UNIT = 1024  # fixed point
_NAMES = list(STATISTICS)
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]
#: Chi-square with five degrees of freedom: its quantiles.
_CHI2 = {0.5: 4.351, 0.75: 6.626, 0.975: 12.833, 0.99: 15.086, 0.999: 20.515, 0.9999: 25.745}
_SPREAD = math.log(_CHI2[0.75] / _CHI2[0.5])
_LOG_BINS = 64  # of distances, to a factor e
#: Estimates that are broadcast; a row of one takes about 400 bytes.
_FEW_GROUPS = 20_000


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    subset: float = 0.75  # share of a group that the estimate covers
    max_steps: int = 12  # concentration steps from the best start
    settled: float = 1e-3  # a lesser gain in a log determinant counts as none
    prior: float = 200.0  # documents that a parent's estimate counts for: one document cannot widen its own group's scatter by more
    tail: float = 0.999  # a key of ``_CHI2``


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, all exact, as one struct-free dict."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+", -1)
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def size_of_cover(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def neighbours(s: Column, same) -> Column:
        return F.filter(s, lambda e, i: F.coalesce(same(e, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(e, F.get(s, i - 1)), F.lit(False)))

    def repeated(h: Column) -> Column:
        # Sorting is fast for long integers: 44 bits of the hash with 20 bits of position.  Where two hashes agree in
        # those 44 bits alone, or positions need more bits, whole hashes are sorted with their positions.
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-(1 << 20))).bitwiseOR(i)))
        at = lambda e: e.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")
        high = lambda a, b: F.shiftright(a, 20) == F.shiftright(b, 20)

        def slow() -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
            return let(pairs, lambda s: size_of_cover(F.transform(neighbours(s, lambda a, b: a["h"] == b["h"]), lambda e: e["p"])))

        def covered(twice: Column) -> Column:
            mixed = F.exists(F.transform(twice, lambda e, i: high(e, F.get(twice, i + 1)) & (F.get(h, at(e)) != F.get(h, at(F.get(twice, i + 1))))), lambda x: F.coalesce(x, F.lit(False)))
            return F.when(mixed, slow()).otherwise(size_of_cover(F.transform(twice, at)))

        fast = let(packed, lambda s: let(neighbours(s, high), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(F.size(h) >= 1 << 20, slow()).otherwise(fast)

    def windows(w: Column) -> Column:
        count = F.when(F.get(w, F.lit(0)) == "", F.lit(0)).otherwise(F.size(w))
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            count.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, repeated)).cast("long").alias("n_repeat_words"),
        )

    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "_w": let(words, windows),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": dup.cast("long"),
        "_lines": let(lines, F.size).cast("long"),
    }


def with_counts(docs: DataFrame, text: str, params: QualityParams, keep: list[str]) -> DataFrame:
    got = docs.select(*keep, *(c.alias(k) for k, c in base_counts(F.col(text)).items()))
    got = got.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "_lines")
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    return got.withColumn("base_failed", failed)


def statistics() -> dict[str, Column]:
    """The transformed statistics as fixed-point integers, from the counts."""
    c = F.col
    share = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1)))
    raw = {
        "log_words": F.log(F.greatest(c("n_words"), F.lit(1)).cast("double")),
        "log_word_length": F.log(F.greatest(c("word_chars"), F.lit(1)) / F.greatest(c("n_words"), F.lit(1))),
        "symbol_share": share(c("n_symbols"), c("word_chars")),
        "dup_lines": share(c("n_dup_lines"), c("_lines")),
        "repeats": share(c("n_repeat_words"), c("n_words")),
    }
    return {k: F.round(v * _UNIT).cast("long") for k, v in raw.items()}


def _distance() -> Column:
    """Squared Mahalanobis distance of the statistics from ``centre`` by the ``inverse`` of the scatter (its lower half, doubled
    off the diagonal).  Long sums are given as SQL text: one call each instead of one for every operation."""
    x = [f"({n} - centre[{i}])" for i, n in enumerate(_NAMES)]
    return F.expr(" + ".join(f"inverse[{k}] * {x[i]} * {x[j]}" for k, (i, j) in enumerate(_PAIRS)))


def _bin(distance: Column) -> Column:
    """A fixed logarithmic scale, so that quantiles of distances need few different values."""
    return F.round(_LOG_BINS * F.log(F.greatest(distance, F.lit(0.0)) + 1e-6)).cast("int")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [f"sum({n}) AS s{i}" for i, n in enumerate(_NAMES)] + [f"sum({_NAMES[i]} * {_NAMES[j]}) AS q{i}_{j}" for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(*(F.expr(x) for x in ["count(1) AS n", *sums]))


def _estimate(moments: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Centre, inverse scatter, log determinant and second moments, from a subset's sums and the parent's share.

    The scatter is swept pivot by pivot; when all are swept, it is the inverse with its sign changed."""
    p = len(_NAMES)
    centre = ", ".join(f"(s{i} + weight * p_centre[{i}]) / (n + weight)" for i in range(p))
    second = ", ".join(f"(q{i}_{j} + weight * p_second[{k}]) / (n + weight)" for k, (i, j) in enumerate(_PAIRS))
    df = moments.join(groups, "g").selectExpr(*keys, "rows", f"array({centre}) AS centre", f"array({second}) AS second")
    added = [(d * _UNIT) ** 2 for d in STATISTICS.values()]
    at = {pair: k for k, pair in enumerate(_PAIRS)}
    scatter = ", ".join(f"second[{at[max(i, j), min(i, j)]}] - centre[{i}] * centre[{j}] + {added[i] if i == j else 0.0!r}D" for i in range(p) for j in range(p))
    pivot = f"m.a[k * {p} + k]"
    cell = (
        f"CASE WHEN c = k * {p} + k THEN -1D / {pivot} WHEN c DIV {p} = k OR c % {p} = k THEN x / {pivot} "
        f"ELSE x - m.a[int(c DIV {p}) * {p} + k] * m.a[k * {p} + c % {p}] / {pivot} END"
    )
    swept = f"aggregate(sequence(0, {p - 1}), struct(array({scatter}) AS a, 0D AS log_det), (m, k) -> struct(transform(m.a, (x, c) -> {cell}) AS a, m.log_det + ln({pivot}) AS log_det))"
    inverse = ", ".join(f"{-1 if i == j else -2} * swept.a[{i * p + j}]" for i, j in _PAIRS)
    return df.selectExpr("*", f"{swept} AS swept").selectExpr(*keys, "rows", "centre", f"array({inverse}) AS inverse", "second", "swept.log_det AS log_det")


def mcd(stats: DataFrame, groups: DataFrame, params: QualityParams) -> DataFrame:
    """Per group: centre, inverse scatter, second moments, and ``middle`` and ``spread`` of the logs of squared distances.

    ``stats`` has the group ``g`` and the statistics; ``groups`` has per group its number of ``rows`` and what its parent gives:
    ``weight`` (in documents), ``p_centre``, ``p_second``, ``p_middle`` and ``p_spread``."""
    size = groups.agg(F.count(F.lit(1)).alias("k"), F.sum("rows").alias("n")).first()
    few, total = size["k"] <= _FEW_GROUPS, size["n"] or 0

    def attach(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
        if few:  # a count that was checked
            return rows.join(F.broadcast(small.drop("rows")), keys)
        return join_spread(rows, small, keys, "rows", total)

    def concentrate(at: DataFrame, keys: list[str]) -> DataFrame:
        rows = attach(stats, at.select(*keys, "rows", "centre", "inverse"), ["g"]).select(*keys, *_NAMES, _bin(_distance()).alias("_b"))
        limit = rows.groupBy(*keys).agg(F.percentile("_b", F.lit(params.subset)).alias("_limit"), F.count(F.lit(1)).alias("rows"))
        return _estimate(_moments(attach(rows, limit, keys).filter("_b <= _limit"), keys), groups, keys)

    quarters = [f"percentile({n}, array(0.25D, 0.5D, 0.75D)) AS _q{i}" for i, n in enumerate(_NAMES)]
    middle = cut(stats.groupBy("g").agg(*(F.expr(x) for x in [*quarters, "count(1) AS rows"])))
    floors = list(STATISTICS.values())
    z = [F.expr(f"abs({n} - _q{i}[1]) / greatest((_q{i}[2] - _q{i}[0]) / 1.349D, {floors[i] * _UNIT}D)") for i, n in enumerate(_NAMES)]
    starts = [sum((x * x for x in z[1:]), z[0] * z[0]), F.greatest(*z), sum(z[1:], z[0])]
    rows = attach(stats, middle, ["g"]).select("g", *_NAMES, *(_bin(x).alias(f"_b{k}") for k, x in enumerate(starts)))
    limits = rows.groupBy("g").agg(*(F.percentile(f"_b{k}", F.lit(params.subset)).alias(f"_l{k}") for k in range(len(starts))), F.count(F.lit(1)).alias("rows"))
    inside = F.filter(F.array(*(F.when(F.col(f"_b{k}") <= F.col(f"_l{k}"), F.lit(k)) for k in range(len(starts)))), lambda k: k.isNotNull())
    rows = attach(rows, limits, ["g"]).select("g", *_NAMES, F.explode(inside).alias("start"))
    at = cut(_estimate(_moments(rows, ["g", "start"]), groups, ["g", "start"]))
    at = cut(concentrate(at, ["g", "start"]))
    names = ["rows", "centre", "inverse", "second", "log_det"]
    at = at.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("log_det", "start")).alias("b")).select("g", "b.*")
    for _ in range(params.max_steps):
        more = concentrate(at, ["g"])
        both = at.join(more.select("g", *(F.col(n).alias(f"n_{n}") for n in names)), "g")
        better = F.col("n_log_det") < F.col("log_det") - params.settled
        both = cut(both.select("g", better.alias("better"), *(F.when(better, F.col(f"n_{n}")).otherwise(F.col(n)).alias(n) for n in names)))
        at = both.drop("better")
        if not both.agg(F.max("better")).first()[0]:
            break
    far = attach(stats, at.select("g", "rows", "centre", "inverse"), ["g"]).select("g", _bin(_distance()).alias("_b"))
    scale = far.groupBy("g").agg(F.percentile("_b", F.lit(0.5)).alias("_half"), F.percentile("_b", F.lit(0.75)).alias("_upper"))
    drawn = lambda own, parent: (F.col("rows") * own + F.col("weight") * F.col(parent)) / (F.col("rows") + F.col("weight"))
    found = at.drop("rows").join(scale, "g").join(groups, "g")
    return cut(found.select(
        "g", "centre", "inverse", "second",
        drawn(F.col("_half") / _LOG_BINS, "p_middle").alias("middle"),
        drawn((F.col("_upper") - F.col("_half")) / _LOG_BINS, "p_spread").alias("spread"),
    ))


def estimates(passed: DataFrame, params: QualityParams) -> DataFrame:
    """Estimates of all documents, then of languages, then of sources: (_l, _s, centre, inverse, middle, spread)."""
    key = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    sizes = cut(passed.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("rows")).withColumns({"l": key("_lang"), "s": key("_lang", "_source")}))
    none = {"weight": F.lit(0.0), "p_centre": F.array(*[F.lit(0.0)] * len(_NAMES)), "p_second": F.array(*[F.lit(0.0)] * len(_PAIRS)), "p_middle": F.lit(0.0), "p_spread": F.lit(0.0)}
    groups = sizes.groupBy(F.lit("all").alias("g")).agg(F.sum("rows").alias("rows")).withColumns(none)
    found = mcd(passed.select(F.lit("all").alias("g"), *_NAMES), groups, params)

    def children(groups: DataFrame, of: str) -> DataFrame:
        parent = found.select(F.col("g").alias(of), F.col("centre").alias("p_centre"), F.col("second").alias("p_second"), F.col("middle").alias("p_middle"), F.col("spread").alias("p_spread"))
        return cut(groups.join(parent, of).drop(of).withColumn("weight", F.lit(params.prior)))

    groups = children(sizes.groupBy(F.col("l").alias("g")).agg(F.sum("rows").alias("rows")).withColumn("of", F.lit("all")), "of")
    found = mcd(passed.select(key("_lang").alias("g"), *_NAMES), groups, params)
    groups = children(sizes.select(F.col("s").alias("g"), "rows", F.col("l").alias("of")), "of")
    found = mcd(passed.select(key("_lang", "_source").alias("g"), *_NAMES), groups, params)
    return sizes.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), F.col("rows"), F.col("s").alias("g")).join(found, "g").drop("g", "second")


def quality_verdicts(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", params: QualityParams = QualityParams()
) -> DataFrame:
    """Per row: id, counts, ``base_failed``, ``distance`` (null where the base rules fail) and ``kept``."""
    names = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    counted = with_counts(names, "_text", params, ["_id", "_lang", "_source"])
    rows = staged(counted.withColumns(statistics()), "quality")
    found = cut(estimates(rows.filter(~F.col("base_failed")), params))
    size = found.agg(F.count(F.lit(1)).alias("k"), F.sum("rows").alias("n")).first()
    same = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    hot = F.lit(True) if size["k"] <= _FEW_GROUPS else F.col("rows") * 2048 > size["n"]  # fewer than 2048 groups
    judged = rows.join(F.broadcast(found.filter(hot)), same, "left")
    if size["k"] > _FEW_GROUPS:
        near = rows.join(F.broadcast(found.filter(hot).select("_l", "_s")), same, "left_anti")
        judged = judged.filter("_s IS NOT NULL OR _l IS NOT NULL OR centre IS NOT NULL").unionByName(near.join(found.filter(~hot), same, "left"))
    scaled = F.log(F.lit(_CHI2[0.5])) + _SPREAD * (F.log(F.greatest(_distance(), F.lit(0.0)) + 1e-6) - F.col("middle")) / F.greatest(F.col("spread"), F.lit(_SPREAD))
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.exp(scaled)))
    kept = F.when(F.col("base_failed"), False).otherwise(F.col("distance") <= _CHI2[params.tail])
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance"
    )


def quality_filter(docs: DataFrame, id_col: str = "doc_id", params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.  Rows that share an id share a verdict: all must be kept."""
    bad = quality_verdicts(docs, id_col, params=params).filter(~F.col("kept")).select(F.col(id_col).alias("__rejected")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__rejected")), "left_anti")
