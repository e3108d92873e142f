"""Jaccard self-join on sets of five-word shingles, exact, by a grouped prefix join.

Words are runs of anything but white space, A-Z lower-cased.  A text of fewer than five words has its whole sequence as
its one shingle; a text without words has none and is linked with nothing.  Two texts link when
``100 * intersection >= 80 * union``.

1. Texts with equal sets are one class (a 64-bit digest of the set; its node).  A second digest tells different sets with
   the same first one apart, and those take the second one as node.
2. A global order of shingles puts frequent ones last: tasks send sorted, delta-coded hashes of their texts to ranges,
   where exact numbers of texts are counted; the ``frequent`` most common ones are kept.  The order only decides how much
   work follows, never which links are found, so the bound on that list loses nothing.
3. Sets that reach 0.8 share one of their first ``n - ceil(0.8 n) + 1`` shingles in that order.  Classes with the same
   size and the same prefix form a group; an inverted index over prefixes holds groups.
4. In each index entry only a star is verified: around its most common member, that with the smallest share of shingles
   that few texts have; in each group likewise.  Entries (and groups) whose members then lie in one component need no more
   work; for the rest, the pairs across components that were not yet compared are verified, less those whose parities
   (one bit per bucket of hashes) already differ in more bits than linked sets may differ in shingles.  So no entry emits all of its pairs, and no link between
   different components is missed.
5. A pair's sets may differ in a ninth of their sizes' sum; pairs whose slices (a sixth of the hashes) differ by more are
   put aside at once.  For the others whole sets are intersected.  Links become components by alternating stars.

Frequent shingles that a prefix still holds have their entries built by DataFrame aggregation, entries with a great share of
all rows are broadcast by their keys, and what is left to compare in an entry is dealt out by pairs of blocks, so an entry
with a third of all texts never meets in one task.

Defined cases: null and empty texts keep their row with n_shingles 0 and their own id as component; rows without an id are
returned with their set size, and count as one document without id; texts of any length are read whole; repeated rows are
all returned; an empty table gives an empty result; rows that share an id are one document in the links; of the documents'
columns only the id and the text are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import shingle_sets
from ._spark import cut, join_spread, prepare, release, staged, tidy
from .components import connected_components

_U64, _U32, _I64 = np.uint64, np.uint32, np.int64
SLICES = 6
PARITY = 1024  # bits


@dataclass(frozen=True)
class JoinParams:
    percent: int = 80
    frequent: int = 200_000  # shingles put last in the order: a broadcast of 12 bytes each
    frequent_from: int = 16  # in how many texts a shingle must be to count as frequent
    range_shingles: int = 1 << 23  # shingles per range of the index, which one task sorts
    block: int = 2000  # members of an open entry that meet others in one task
    broadcast_ids: int = 1_000_000  # most ids that are broadcast to pick texts; more go by a shuffle


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _digests(held: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    both = blake2b(held.tobytes(), digest_size=16).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _node(held: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """A set's node: its first digest, or the second where different sets share the first."""
    first, second = _digests(held)
    return second if first in shared else first


def _shared_digests(rows: DataFrame, limit: int = 100_000) -> frozenset[int]:
    """First digests that different sets have: about n * n / 2 ** 65 of n different texts."""
    twice = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("again").alias("x"), F.max("again").alias("y")).filter("x != y")
    found = twice.select("node").limit(limit + 1).collect()
    if len(found) > limit:
        raise RuntimeError("too many different sets share a digest")
    return frozenset(r["node"] for r in found)


def shingle_classes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, n, node, again, slice, parity) per row; rows with equal sets share both digests, which are null for an empty set.

    The slice has 32 bits of every shingle whose hash is divisible by ``SLICES``.  The parity has a bit per bucket of hashes,
    set where the number of shingles is odd: two sets differ in at least as many shingles as their parities in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, again, part, odd = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                digests = _digests(s) if len(s) else (None, None)
                node.append(digests[0])
                again.append(digests[1])
                part.append(np.unique((s[s % _U64(SLICES) == 0] >> _U64(32)).astype(_U32)).tobytes())
                counts = np.bincount((s & _U64(PARITY - 1)).astype(_I64), minlength=PARITY)
                odd.append(np.packbits(counts.astype(np.uint8) & 1).view(_I64))
            flat = np.concatenate(odd) if odd else np.empty(0, _I64)
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1) * (PARITY // 64), pa.int32()), pa.array(flat))
            columns = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(again, pa.int64()), pa.array(part, pa.binary()), parity]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "node", "again", "slice", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, node long, again long, slice binary, parity array<long>")


def _frequent(docs: DataFrame, text: str, ranges: int, params: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles (their 40 leading bits, sorted) and their numbers of texts."""
    bits = (ranges - 1).bit_length()
    batch_size = max(1 << 21, min(16 * ranges, 1 << 23))  # hashes held before they are dealt out

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) >> (_U64(32) - _U64(bits))  # bits for the range, 32 for the rest
            held.clear()
            cuts = np.searchsorted(keys >> _U64(32), np.arange(ranges + 1, dtype=_U64))
            out, some = [], np.flatnonzero(np.diff(cuts))
            for r in some:
                part = (keys[cuts[r] : cuts[r + 1]] & _U64(0xFFFFFFFF)).astype(_U32)
                deltas = np.diff(part, prepend=_U32(0))
                out.append(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 4).T).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out, pa.binary())], ["range", "blob"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                held.append(s)
            if sum(map(len, held)) > batch_size:
                yield flush()
        if held:
            yield flush()

    def count(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for blob in frames["blob"]:
            planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
            parts.append(np.cumsum(np.ascontiguousarray(planes.T).view(_U32).ravel(), dtype=_U32))
        keys = np.sort(np.concatenate(parts)) if parts else np.empty(0, _U32)
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
        counts = np.diff(edges)
        often = counts >= params.frequent_from
        full = (_I64(key[0]) << _I64(32)) | keys[edges[:-1]][often].astype(_I64) if len(keys) else np.empty(0, _I64)
        return pd.DataFrame({"token": full, "count": counts[often].astype(_I64) if len(keys) else np.empty(0, _I64)})

    blobs = docs.select(F.col(text).alias("text")).mapInArrow(blocks, "range int, blob binary")
    counted = staged(blobs.groupBy("range").applyInPandas(count, "token long, count long"), "counts")
    # The least count of which no more than ``frequent`` shingles have as many: from a histogram of eighths of octaves.
    step = F.floor(8 * F.log2(F.col("count").cast("double"))).cast("int")
    least, taken = None, 0
    for row in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("count").alias("low")).orderBy(F.desc("step")).collect():  # a few hundred rows
        if taken + row["k"] > params.frequent:
            break
        least, taken = row["low"], taken + row["k"]
    got = counted.filter(F.col("count") >= (least or 1)).toPandas() if taken else pd.DataFrame({"token": [], "count": []})  # at most ``frequent`` rows
    release(counted)
    got = got.sort_values("token")
    return got["token"].to_numpy(_I64).astype(_U64), got["count"].to_numpy(_I64)


def _index_rows(docs: DataFrame, text: str, ranges: int, params: JoinParams, tokens: np.ndarray, counts: np.ndarray, alike: frozenset[int]) -> DataFrame:
    """Per block of texts: kind 0, groups by range with their prefix shingles; kind 1, groups under frequent shingles;
    kind 2, members of groups."""
    spark = docs.sparkSession
    bits = (ranges - 1).bit_length()
    shared = spark.sparkContext.broadcast((tokens, counts))  # at most ``frequent`` entries
    schema = "kind int, range int, gid binary, n binary, node binary, token binary, at binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value

        def block(sets: list[np.ndarray]) -> pa.RecordBatch:
            gids, sizes, nodes, prefixes, common = [], [], [], [], []
            seen: set[int] = set()
            groups: set[int] = set()
            members: list[tuple[int, int, int, int]] = []
            for s in sets:
                node = _node(s, alike)
                if node in seen:
                    continue
                seen.add(node)
                p = prefix_length(len(s), params.percent)
                lead = s >> (_U64(32) - _U64(bits))
                if len(tokens):
                    where = np.minimum(np.searchsorted(tokens, lead), len(tokens) - 1)
                    often = tokens[where] == lead
                else:
                    where, often = np.zeros(len(s), int), np.zeros(len(s), bool)
                rare = s[~often][:p]
                rest = np.empty(0, _U64)
                if len(rare) < p:
                    rest, many = s[often], counts[where[often]]
                    rest = rest[np.lexsort((rest, many))][: p - len(rare)]
                gid = int.from_bytes(blake2b(rare.tobytes() + b"|" + rest.tobytes() + len(s).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                members.append((gid, len(s), node, 1000 * int(np.count_nonzero(~often)) // len(s)))
                if gid not in groups:
                    groups.add(gid)
                    gids.append(gid)
                    sizes.append(len(s))
                    prefixes.append(rare)
                    common.append(rest)
            rows: list[tuple] = []
            if members:
                m = np.array(members, _I64).reshape(-1, 4)
                rows.append((2, 0, m[:, 0].tobytes(), m[:, 1].tobytes(), m[:, 2].tobytes(), m[:, 3].tobytes(), b""))
            for kind, lists in ((0, prefixes), (1, common)):
                flat = np.concatenate(lists) if lists else np.empty(0, _U64)
                if not len(flat):
                    continue
                at = np.repeat(np.arange(len(lists), dtype=_U32), [len(x) for x in lists])
                g, n = np.array(gids, _I64), np.array(sizes, _I64)
                if kind:
                    rows.append((1, 0, g[at].tobytes(), n[at].tobytes(), b"", flat.view(_I64).tobytes(), b""))
                    continue
                which = (flat >> (_U64(64) - _U64(bits))).astype(_I64)
                order = np.argsort(which, kind="stable")
                cuts = np.searchsorted(which[order], np.arange(ranges + 1))
                for r in np.flatnonzero(np.diff(cuts)):
                    take = order[cuts[r] : cuts[r + 1]]
                    local, back = np.unique(at[take], return_inverse=True)
                    low = ((flat[take] >> (_U64(32) - _U64(bits))) & _U64(0xFFFFFFFF)).astype(_U32)
                    rows.append((0, int(r), g[local].tobytes(), n[local].tobytes(), b"", low.tobytes(), back.astype(_U32).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "range", "gid", "n", "node", "token", "at"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if len(s):
                    held.append(s)
                    size += len(s)
                if size > 1 << 21:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, schema)


def _entries(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
    """Index entries of one range: their groups, each different list of groups once.  A list has fewer than
    ``frequent_from`` texts, or the few more that a shingle beyond the frequent ones may have."""
    gid, token = [], []
    for g, t, at in zip(frames["gid"], frames["token"], frames["at"], strict=True):
        gid.append(np.frombuffer(g, _I64)[np.frombuffer(at, _U32)])
        token.append(np.frombuffer(t, _U32))
    g, t = np.concatenate(gid), np.concatenate(token)
    order = np.lexsort((g, t))
    g, t = g[order], t[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])  # groups that several blocks hold
    g, t = g[new], t[new]
    edges = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1], [True])))
    seen: set[int] = set()
    out_e: list[np.ndarray] = []
    out_g: list[np.ndarray] = []
    for k in np.flatnonzero(np.diff(edges) > 1):
        part = g[edges[k] : edges[k + 1]]
        entry = int.from_bytes(blake2b(part.tobytes(), digest_size=8).digest(), "little", signed=True)
        if entry not in seen:
            seen.add(entry)
            out_e.append(np.full(len(part), entry, _I64))
            out_g.append(part)
    none = np.empty(0, _I64)
    return pd.DataFrame({"entry": np.concatenate(out_e) if out_e else none, "gid": np.concatenate(out_g) if out_g else none})


def _expand(rows: DataFrame, names: list[str], schema: str) -> DataFrame:
    """Rows of packed 64-bit integers, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = [pa.array(np.frombuffer(batch.column(c)[i].as_py(), _I64)) for c in range(batch.num_columns)]
                for k in range(0, len(arrays[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([a.slice(k, 50_000) for a in arrays], names)

    return rows.mapInArrow(run, schema)


def _likely(pairs: DataFrame, slices: DataFrame, percent: int) -> DataFrame:
    """The pairs whose slices differ by no more than the whole sets may: a cheap test that loses no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, nx, ny in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                both = np.concatenate((np.frombuffer(x.as_buffer(), _U32), np.frombuffer(y.as_buffer(), _U32)))
                both.sort(kind="stable")
                unlike = len(both) - 2 * int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(unlike * (100 + percent) <= (nx.as_py() + ny.as_py()) * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = slices.toDF("a", "x", "nx"), slices.toDF("b", "y", "ny")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, id_col: str, text: str, wanted: DataFrame, limit: int, alike: frozenset[int]) -> DataFrame:
    """(node, held) of the wanted classes, from the text of one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(0))]
            keep = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s, alike) for s in keep], pa.int64()), pa.array([s.tobytes() for s in keep], pa.binary())], ["node", "held"])

    ids = cut(wanted.select(F.col("first").alias("__first")).distinct())
    if ids.count() <= limit:
        ids = F.broadcast(ids)
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).alias("text"))
    return own.join(ids, F.col("__id") == F.col("__first"), "left_semi").select("text").mapInArrow(run, "node long, held binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, link) of pairs (a, b) by intersecting their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U64), np.frombuffer(y.as_buffer(), _U64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                links.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.bool_())], ["a", "b", "link"])

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, link boolean")


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id that links reach) and ``class_id`` (smallest id with the same set)."""
    spark = prepare(docs.sparkSession)
    rows = staged(shingle_classes(docs, id_col, text), "classes")
    alike = _shared_digests(rows)
    if alike:
        rows = rows.withColumn("node", F.when(F.col("node").isin(list(alike)), F.col("again")).otherwise(F.col("node")))
    size = rows.agg(F.sum("n")).first()[0] or 0
    ranges = 1 << max(6, (int(size) // params.range_shingles).bit_length())
    tokens, counts = _frequent(docs, text, ranges, params)
    index = staged(_index_rows(docs, text, ranges, params, tokens, counts, alike), "index")
    tidy(spark)

    members = _expand(index.filter("kind = 2").select("gid", "n", "node", "token"), ["gid", "n", "node", "odd"], "gid long, n long, node long, odd long")
    members = staged(members.distinct(), "members")
    rare = index.filter("kind = 0").groupBy("range").applyInPandas(_entries, "entry long, gid long").distinct()
    often = staged(_expand(index.filter("kind = 1").select("token", "gid"), ["entry", "gid"], "entry long, gid long").distinct(), "often")
    same = often.groupBy("entry").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("gid")).alias("x"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("y"))
    same = cut(same.groupBy("k", "x", "y").agg(F.min("entry").alias("entry")).select("entry", "k"))
    often = join_spread(often, same, ["entry"], "k", often.count())

    # The star of each entry and of each group around its most common member: that with the fewest shingles of its own.
    groups = cut(members.groupBy("gid").agg(F.min(F.struct("odd", "node")).alias("c"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k")))
    groups = groups.select("gid", F.col("c.odd").alias("odd"), F.col("c.node").alias("lead"), "n", "k")
    entries = staged(rare.union(often).join(groups, "gid"), "entries")
    release(index)
    tidy(spark)
    close = lambda a, b: (100 * F.least(a, b) >= params.percent * F.greatest(a, b))
    hubs = cut(entries.groupBy("entry").agg(F.min(F.struct("odd", "lead", "n")).alias("hub"), F.count(F.lit(1)).alias("of")))
    star = join_spread(entries, hubs, ["entry"], "of", entries.count()).filter((F.col("lead") != F.col("hub.lead")) & close(F.col("n"), F.col("hub.n"))).select(F.col("hub.lead").alias("a"), F.col("lead").alias("b"))
    inner = members.join(groups.filter("k > 1").select("gid", "lead"), "gid").filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first_pairs = cut(ordered(star.union(inner)))

    # Slices first, then whole sets of the classes in pairs that are left.
    firsts = staged(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.max("n").alias("n")), "firsts")
    lone = firsts.select(F.col("node").alias("__n"), F.col("first").alias("__f"))
    own = rows.join(lone, (F.col("id") == F.col("__f")) & (F.col("node") == F.col("__n")))
    slices = own.select("node", "slice", "n")

    def compared(pairs: DataFrame) -> DataFrame:
        likely = cut(_likely(pairs, slices, params.percent))
        nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        sets = staged(_sets(docs, id_col, text, firsts.join(nodes, "node", "left_semi"), params.broadcast_ids, alike), "sets")
        done = cut(_verified(likely, sets, params.percent).filter("link").select("a", "b").distinct())
        tidy(spark)
        return done

    links = compared(first_pairs)
    labels = cut(connected_components(links))

    # Pairs across components of one entry, or of one group, that were not yet compared and whose parities are near.
    every = entries.select("entry", "gid").union(groups.filter("k > 1").select(F.col("gid").alias("entry"), "gid"))
    who = every.join(members, "gid").join(labels, "node", "left").select("entry", "node", "n", F.coalesce("label", "node").alias("label")).distinct()
    who = staged(who, "open")
    mixed = who.groupBy("entry").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("of")).filter("p != q")
    mixed = cut(mixed.select("entry", "of", F.ceil(F.col("of") / params.block).cast("int").alias("blocks")))
    open_rows, who = who, join_spread(who, mixed, ["entry"], "of", who.count()).join(own.select("node", "parity"), "node").select("entry", "blocks", "node", "n", "label", "parity")
    # An entry's members are cut into blocks, and two blocks meet in a task of their own.
    who = who.withColumn("block", F.pmod(F.xxhash64("node", "entry"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    who = staged(who.select("entry", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "label", "parity"), "mixed")
    release(open_rows)
    x, y = who.filter("block = i").toDF("entry", "i", "j", "bx", "a", "na", "la", "pa"), who.filter("block = j").toDF("entry", "i", "j", "by", "b", "nb", "lb", "pb")
    apart = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(1, PARITY // 64)), F.bit_count(F.col("pa")[0].bitwiseXOR(F.col("pb")[0])))
    near = apart * (100 + params.percent) <= (F.col("na") + F.col("nb")) * (100 - params.percent)
    meet = x.join(y, ["entry", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    cross = meet.filter((F.col("la") != F.col("lb")) & close(F.col("na"), F.col("nb")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = cut(cross.join(first_pairs, ["a", "b"], "left_anti"))
    more = compared(cross)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    joined = more.join(known, "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = connected_components(joined).toDF("label", "top")
    tidy(spark)

    base = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    base = base.join(merged, "label", "left").select("node", "first", F.coalesce("top", "label").alias("label"))
    least = base.groupBy("label").agg(F.min("first").alias("component"))
    found = cut(base.join(least, "label").select(F.col("node").alias("__n"), "first", "component"))
    full = rows.filter("node IS NOT NULL").join(found, F.col("node") == F.col("__n")).select("id", "n", "component", "first")
    empty = rows.filter("node IS NULL").select("id", "n", "id", "id")
    return full.union(empty).toDF(id_col, "n_shingles", "component_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` less every row whose component has a smaller id; of rows that share an id and survive, all stay."""
    gone = ngram_classes(docs, id_col, text, params).filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
