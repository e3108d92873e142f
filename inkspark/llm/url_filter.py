"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the rule's path; of several, the
longest decides.  The trees are trained here from labelled urls: to block are those whose host names a product of the trade in
``SEED_TERMS``, to allow are other urls that a rule allows.  What a rule blocks without such a term says where a page stands
rather than what its url looks like, and is not learned.  At most ``sample`` different labelled urls are taken, half of each
label where there are enough, by a threshold on their hashes that is derived from their number, so that no more than these reach
the driver; copies of a url count once.  Both labels weigh the same.

Features are length, depth, digit ratio, entropy, counts of parameters and separators, and smoothed block rates of host
suffixes.  A url's suffix rates come from the other hosts' folds while the trees are fitted, so they do not hold its own
label; :func:`held_out` gives the error on hosts that neither trees nor rates have seen.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged by the features of
an empty url; urls of any length are read whole; without labelled urls of both kinds the method allows; repeated rows
are kept; an empty table gives an empty result; of the pages' columns only the id and the url are read, so other columns'
names cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import prepare

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
N_FEATURES = 18
#: Words that label a host as unwanted.
SEED_TERMS = ("spam", "pills", "casino", "viagra", "xxx", "poker", "replica", "payday", "escort", "warez")


@dataclass(frozen=True)
class UrlParams:
    sample: int = 20_000
    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    columns: float = 0.3  # share of the features that a tree may use, so that not one alone decides
    threshold: float = 0.5
    folds: int = 5  # of hosts, for rates and for held-out error


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, r"(?s)^.*?://", ""), "#", 1)).otherwise("")
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(rest, F.length(host) + 1, F.length(rest))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def features(url: str | None, host: str, path: str, rates: dict[str, float], mean: float) -> list[float]:
    url = url or ""
    n = max(len(url), 1)
    counts = Counter(url)
    labels = host.split(".")
    query = url.partition("#")[0].partition("?")[2]
    suffix = lambda k: rates.get(".".join(labels[-k:]), mean) if host and len(labels) >= k else mean
    return [
        len(url), len(host), len(path), len(labels), path.count("/"), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in path),
        -sum(k / n * math.log2(k / n) for k in counts.values()), len([p for p in query.split("&") if p]), counts["-"], counts["%"], counts["_"],
        host.count("-"), max(map(len, labels)), len(path.rpartition(".")[2]) if "." in path else 0, suffix(1), suffix(2), suffix(3),
    ]


def _stats(rows: list[tuple[str, int]]) -> tuple[dict[str, float], float]:
    """Smoothed block rates of host suffixes."""
    mean = sum(y for *_, y in rows) / max(len(rows), 1)
    total: Counter = Counter()
    bad: Counter = Counter()
    for host, y in rows:
        labels = host.split(".")
        keys = {".".join(labels[-k:]) for k in (1, 2, 3) if len(labels) >= k}
        total.update(keys)
        bad.update(keys if y else ())
    return {k: (bad[k] + 5 * mean) / (n + 5) for k, n in total.items() if n >= 5}, mean


class Boosted:
    """Logistic gradient boosting over binned features; each tree is complete, of a fixed depth."""

    def __init__(self, params: UrlParams):
        self.params = params
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Rows of both labels weigh the same in sum."""
        p = self.params
        if len(set(y.tolist())) < 2:
            self.start = -20.0
            return self
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.start)
        rng = np.random.default_rng(0)
        for _ in range(p.trees):
            usable = np.sort(rng.choice(x.shape[1], max(1, round(p.columns * x.shape[1])), replace=False))
            prob = 1 / (1 + np.exp(-score))
            g, h = weight * (y - prob), weight * prob * (1 - prob)
            feature, border = np.zeros(2**p.depth - 1, int), np.full(2**p.depth - 1, np.inf)
            leaf = np.zeros(len(y), int)
            for level in range(p.depth):
                for node in range(2**level):
                    rows = np.flatnonzero(leaf == node)
                    best = (1e-9, 0, None)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f in usable:
                        c = cuts[f]
                        if not len(c) or len(rows) < 10:
                            continue
                        gb = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                        hb = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                        gain = gb**2 / (hb + 1) + (gs - gb) ** 2 / (hs - hb + 1) - gs**2 / (hs + 1)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], f, c[k])
                    if best[2] is not None:
                        feature[2**level - 1 + node], border[2**level - 1 + node] = best[1], best[2]
                at = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[at]] > border[at])
            value = p.rate * np.bincount(leaf, g, 2**p.depth) / (np.bincount(leaf, h, 2**p.depth) + 1)
            self.trees.append((feature, border, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, border, value in self.trees:
            leaf = np.zeros(len(x), int)
            for level in range(self.params.depth):
                at = 2**level - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[at]] > border[at])
            score += value[leaf]
        return 1 / (1 + np.exp(-score))


def _fold(host: str, folds: int) -> int:
    """Hosts of one registered name (the last three labels at most) share a fold."""
    return zlib.crc32(".".join(host.split(".")[-3:]).encode()) % folds


def train(labelled: list[tuple[str, str, str, int]], params: UrlParams = UrlParams()) -> tuple[Boosted, dict[str, float], float]:
    """From (url, host, path, 1 to block): trees, block rates of suffixes, and the rate of unknown suffixes."""
    x = np.zeros((len(labelled), N_FEATURES))
    fold = np.array([_fold(r[1], params.folds) for r in labelled], int)
    for k in range(params.folds):  # rates from the other folds
        rates, mean = _stats([(r[1], r[3]) for r, f in zip(labelled, fold, strict=True) if f != k])
        for i in np.flatnonzero(fold == k):
            x[i] = features(*labelled[i][:3], rates, mean)
    rates, mean = _stats([(r[1], r[3]) for r in labelled])
    return Boosted(params).fit(x, np.array([y for *_, y in labelled], float)), rates, mean


def held_out(labelled: list[tuple[str, str, str, int]], params: UrlParams = UrlParams()) -> dict[str, float]:
    """Error rates over the folds, each judged by a model of the others: all, allowed urls blocked, blocked urls allowed."""
    wrong, n = [0, 0], [0, 0]
    for k in range(params.folds):
        rest = [r for r in labelled if _fold(r[1], params.folds) != k]
        part = [r for r in labelled if _fold(r[1], params.folds) == k]
        if not part:
            continue
        model, rates, mean = train(rest, params)
        got = model.predict(np.array([features(*r[:3], rates, mean) for r in part], float)) > params.threshold
        for (*_, y), block in zip(part, got, strict=True):
            n[y] += 1
            wrong[y] += int(block != bool(y))
    return {"urls": sum(n), "error": sum(wrong) / max(sum(n), 1), "blocked_of_allowed": wrong[0] / max(n[0], 1), "allowed_of_blocked": wrong[1] / max(n[1], 1)}


def labelled_urls(own: DataFrame, terms: tuple[str, ...], params: UrlParams) -> list[tuple[str, str, str, int]]:
    """At most ``sample`` different labelled urls (url, host, path, 1 to block), the same whatever the partitions."""
    seeded = F.col("host").rlike("|".join(terms)) if terms else F.lit(False)
    label = F.when(seeded, 1).when(F.col("ruled") == "allow", 0)
    labelled = own.filter("url IS NOT NULL").withColumn("y", label).filter("y IS NOT NULL").select("url", "host", "path", "y").distinct()
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = params.sample // 2
    want = {y: max(half, params.sample - sizes.get(1 - y, 0)) for y in (0, 1)}
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30))
    share = {y: min(1.0, 1.1 * want[y] / max(sizes.get(y, 0), 1)) for y in (0, 1)}
    few = labelled.withColumn("h", place).filter(F.col("h") < F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))
    found = sorted((r["h"], r["url"], r["host"], r["path"], r["y"]) for r in few.collect())  # about 1.1 times ``sample``
    return [r[1:] for y in (0, 1) for r in [f for f in found if f[4] == y][: want[y]]]


def ruled_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """Per row: id, url, host, path, rule and ``ruled``, the rule's verdict (null where no rule fits)."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    return own.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", "m.rule", F.col("m.verdict").alias("ruled"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, terms: tuple[str, ...] = SEED_TERMS, params: UrlParams = UrlParams()) -> DataFrame:
    """Per row: id, host, path, rule, verdict and ``score`` (the trees' probability to block)."""
    spark = prepare(pages.sparkSession)
    own = ruled_urls(pages, id_col, url, rules)
    shared = spark.sparkContext.broadcast(train(labelled_urls(own, terms, params), params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates, mean = shared.value
        for batch in batches:
            urls, hosts, paths, ruled = (batch.column(k).to_pylist() for k in (1, 2, 3, 5))
            x = np.array([features(u, h, p, rates, mean) for u, h, p in zip(urls, hosts, paths, strict=True)], float).reshape(-1, N_FEATURES)
            score = model.predict(x) if len(urls) else np.empty(0)
            verdict = [r or ("block" if s > params.threshold else "allow") for r, s in zip(ruled, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], ["id", "host", "path", "rule", "verdict", "score"])

    return own.mapInArrow(run, "id long, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
