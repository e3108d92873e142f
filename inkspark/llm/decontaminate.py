"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of anything but white space, A-Z lower-cased; shingles are five words (a shorter item or text is one
shingle), weighted by how often they occur.  A window has as many words as an item.  Windows are laid over a text
wherever one of an item's shingles stands, aligned as in the item; a window without any shingle of an item has similarity
0 to all of them, so no fingerprint is made for it.  The 64-bit SimHash of a window retrieves items of its size within
``radius`` bits: with eight blocks of eight bits, some block of such a pair differs in at most ``radius // 8`` bits, and the
index lists every item under all values that near, so none within the radius is missed.  Candidates are verified by the
exact weighted similarity: the weight of shingles that window and item share over the item's weight, at least 0.8.

The benchmark is the query set: its items are taken in blocks of at most ``block_bytes`` of text, each block against all
documents before the next is sent.  Nothing of the documents is shuffled or gathered.

Defined cases: null and empty texts and items match nothing; items with a null id count, under a null id; a text shorter
than an item is compared as a whole; texts of any length are read whole; a row per document and item gives the best
window, the earliest of equals; repeated rows give one result; empty tables give an empty result; of the documents' columns
only id and text are read by name, and :func:`decontaminated` passes all columns through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._kernels import SHINGLE, shingle_hashes, text_slices, word_hashes, word_spans
from ._spark import prepare, staged


@dataclass(frozen=True)
class DecontaminateParams:
    similarity: float = 0.8
    radius: int = 23  # of 64; a pair at the least similarity differs in about 13 bits
    block_bytes: int = 8 << 20  # text of items at a time; an index takes some thirty times as much


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash of shingle hashes, each weighted by its number of occurrences."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(shingles)).tobytes(), "big")


class ItemIndex:
    """Fingerprints of items by size, in eight tables of eight bits each, and where each shingle stands in an item."""

    def __init__(self, items: list[tuple[int, str]], params: DecontaminateParams):
        self.params = params
        self.ids, self.sizes, self.bags, self.prints, self.totals = [], [], [], [], []
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.blocks: dict[int, list[list[list[int]]]] = {}
        near = [sum(1 << b for b in c) for k in range(params.radius // 8 + 1) for c in combinations(range(8), k)]
        texts = pa.array([t for _, t in items], pa.string())
        row = 0
        for start, stop, data, offsets in text_slices(texts):
            s, e, first = word_spans(data, offsets)
            hashes, at = shingle_hashes(word_hashes(data, s, e), first)
            for k in range(stop - start):
                own, size = hashes[at[k] : at[k + 1]], int(first[k + 1] - first[k])
                item_id = items[row][0]
                row += 1
                if not len(own):
                    continue
                n = len(self.ids)
                self.ids.append(item_id)
                self.sizes.append(size)
                self.bags.append(Counter(own.tolist()))
                self.totals.append(len(own))
                self.prints.append(simhash(own))
                for j, h in enumerate(own.tolist()):
                    places = self.places.setdefault(h, [])
                    if (size, j) not in places:
                        places.append((size, j))
                tables = self.blocks.setdefault(size, [[[] for _ in range(256)] for _ in range(8)])
                for b in range(8):
                    own_bits = (self.prints[n] >> (8 * b)) & 255
                    for flip in near:
                        tables[b][own_bits ^ flip].append(n)
        self.known = np.array(sorted(self.places), np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def within(self, size: int, fingerprint: int) -> list[int]:
        """Items of that size within the radius."""
        tables = self.blocks.get(size)
        if not tables:
            return []
        found = {n for b in range(8) for n in tables[b][(fingerprint >> (8 * b)) & 255]}
        return sorted(n for n in found if (self.prints[n] ^ fingerprint).bit_count() <= self.params.radius)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item id, similarity, first word, distance) of the best window per row and item."""
        for start, _, data, offsets in text_slices(column):
            s, e, first = word_spans(data, offsets)
            hashes, at = shingle_hashes(word_hashes(data, s, e), first)
            hits = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
            if len(hits) and len(self.known):
                where = np.minimum(np.searchsorted(self.known, hashes[hits]), len(self.known) - 1)
                hits = hits[self.known[where] == hashes[hits]]
            if not len(hits):
                continue
            rows = np.searchsorted(at, hits, "right") - 1
            for row in np.unique(rows):
                yield from ((start + int(row), *m) for m in self._row(hashes[at[row] : at[row + 1]], hits[rows == row] - at[row]))

    def _row(self, own: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        windows = set()
        for i in hits.tolist():
            for size, j in self.places[int(own[i])]:
                width = max(1, size - SHINGLE + 1)
                windows.add((size, max(0, min(i - j, len(own) - width))))
        best: dict[int, tuple[float, int, int]] = {}
        for size, begin in sorted(windows):
            held = own[begin : begin + max(1, size - SHINGLE + 1)]
            fingerprint = simhash(held)
            bag = None
            for n in self.within(size, fingerprint):
                bag = bag or Counter(held.tolist())
                shared = sum(min(k, bag[h]) for h, k in self.bags[n].items() if h in bag)
                similarity = shared / self.totals[n]
                if similarity >= self.params.similarity and (n not in best or similarity > best[n][0]):
                    best[n] = (similarity, begin, (self.prints[n] ^ fingerprint).bit_count())
        for n, (similarity, begin, distance) in sorted(best.items()):
            yield self.ids[n], similarity, begin, distance


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, params: DecontaminateParams) -> Iterator[ItemIndex]:
    """Item indexes, one block of items after the other; a block's text is about ``block_bytes``."""
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = 1 + int(size) // params.block_bytes
    own = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t IS NOT NULL")
    for b in range(blocks):
        items = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i").collect()  # bounded by block_bytes
        if items or blocks == 1:
            yield ItemIndex([(r["i"], r["t"]) for r in items], params)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """Per document and item that it holds: ``similarity``, ``first_word`` (from 0) and ``distance`` in bits."""
    spark = prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, item long, similarity double, first_word long, distance long"
    parts: list[DataFrame] = []
    for index in _blocks(benchmark, item_id, item_text, params):
        if parts:  # matches of the block before are written before the next block is sent
            parts[-1] = staged(parts[-1], "matches")
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                found = [(ids[row].as_py(), *rest) for row, *rest in shared.value.matches(batch.column(1))]
                columns = list(zip(*found, strict=True)) if found else [[] for _ in range(5)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "item", "similarity", "first_word", "distance"])

        parts.append(own.mapInArrow(run, schema))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)
    best = found.groupBy("id", "item").agg(F.max_by(F.struct("similarity", "first_word", "distance"), F.struct(F.col("similarity"), -F.col("first_word"))).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias("item_id"), "m.similarity", "m.first_word", "m.distance")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", params: DecontaminateParams = DecontaminateParams()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, unchanged and without a shuffle."""
    spark = prepare(docs.sparkSession)
    at, names = docs.columns.index(text), docs.schema
    kept = docs
    for k, index in enumerate(_blocks(benchmark, item_id, item_text, params)):
        if k:  # what the block before left is written before the next block is sent
            kept = staged(kept, "clean")
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, *_ in shared.value.matches(batch.column(at)):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(run, names)
    return kept
