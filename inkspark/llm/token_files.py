"""Token-id files: fixed-width bit packing with block offsets.

A file holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs (least significant bit
first), so id ``k`` stands at bit ``k * width`` and any range unpacks with numpy, without what comes before it.  Ids are
packed in blocks of ``BLOCK`` so that every block begins on a byte; the block offsets and the documents' ids and token
counts stand in the header::

    magic "IKTB" | version u16 | width u16 | n_documents u64 | n_tokens u64 | n_blocks u64
    doc ids i64[n_documents] | token counts u64[n_documents] | block offsets u64[n_blocks + 1] | packed ids

All numbers are little-endian.  A document set is a sequence of files in ascending order of document ids; each file's bytes
are one row of a Parquet data set in the shared folder, so that Spark commits them as a whole whatever executors do and any
file system will do; :func:`export_files` writes them out as single files where a folder is mounted.

The library encodes every text whole, whatever its length.  Files are told apart by (part, number), never by what they hold.

Defined cases: null and empty texts have the end id alone; null ids come first; repeated rows are kept, in any order
among themselves; a text of any length stands in one file, which is then longer than ``file_tokens``; an empty table gives
no files; of the documents' columns only the id and the text are read, so other columns' names cannot clash.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import prepare, staged

MAGIC, VERSION, BLOCK = b"IKTB", 1, 4096
_HEAD = struct.Struct("<4sHHQQQ")
NO_ID = -(1 << 63)  # stands for a null document id


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} needs more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of packed ``data``, whatever their position."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", stop - start, start * width // 8).astype(np.uint32)
    first, last = start * width // 8, (stop * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, last - first, first), bitorder="little")
    skip = start * width - first * 8
    bits = bits[skip : skip + (stop - start) * width].reshape(-1, width).astype(np.uint32)
    return (bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_file(doc_ids: list[int], counts: list[int], ids: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[k : k + BLOCK], width) for k in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0] + [len(b) for b in blocks]).astype("<u8")
    head = _HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(ids), len(blocks))
    named = np.array([NO_ID if i is None else i for i in doc_ids], "<i8")
    return b"".join([head, named.tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """A reader with random access by document or by token range."""

    def __init__(self, data: bytes):
        magic, version, self.width, n, self.n_tokens, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<u8", n, at + 8 * n)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 16 * n)
        self.packed = memoryview(data)[at + 16 * n + 8 * (blocks + 1) :]
        self.starts = np.concatenate(([0], np.cumsum(self.counts))).astype(np.int64)
        if self.starts[-1] != self.n_tokens or len(self.packed) != int(self.offsets[-1]):
            raise ValueError("the token file is damaged")

    def tokens(self, start: int, stop: int) -> np.ndarray:
        parts = []
        for b in range(start // BLOCK, -(-stop // BLOCK)):
            low, high = max(start - b * BLOCK, 0), min(stop - b * BLOCK, BLOCK)
            parts.append(unpack(self.packed[int(self.offsets[b]) : int(self.offsets[b + 1])], self.width, low, high))
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


@dataclass(frozen=True)
class TokenParams:
    end_id: int = 2
    file_tokens: int = 1 << 20
    batch_chars: int = 1 << 20  # of texts handed to the library at a time; a longer text goes alone


class TextEncoder:
    """The tokenizers library over whole texts, many at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def encode_all(self, texts: list[str], batch_chars: int) -> Iterator[np.ndarray]:
        """Ids of each text, in order; texts go to the library in lists of about ``batch_chars``, equal ones of a list once."""
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= batch_chars):
                size += len(texts[last])
                last += 1
            part = list(dict.fromkeys(texts[first:last]))
            got = {t: np.array(e.ids, np.uint32) for t, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True)}
            yield from (got[t] for t in texts[first:last])
            first = last


_ENCODERS: dict[str, TextEncoder] = {}
_FILES = "part int, number int, first_id long, last_id long, n_documents long, n_tokens long, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", params: TokenParams = TokenParams()) -> DataFrame:
    """Files of the documents in ascending order of ids: (part, number, first_id, last_id, n_documents, n_tokens, data).

    ``part`` is the range of ids and ``number`` the file's place in it, so the two order all files and are different
    for each, whatever the files hold."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _ENCODERS.setdefault(tokenizer_path, None) or TextEncoder(tokenizer_path)
        _ENCODERS[tokenizer_path] = encoder
        width = width_for(encoder.tokenizer.get_vocab_size())
        part = TaskContext.get().partitionId()
        number, size = 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            data = write_file(ids, [len(x) for x in held], np.concatenate(held), width)
            row = [part, number, ids[0], ids[-1], len(ids), size, data]
            kinds = [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _FILES.split(", ")])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, got in zip(batch.column(0).to_pylist(), encoder.encode_all(texts, params.batch_chars), strict=True):
                ids.append(doc_id)
                held.append(np.append(got, np.uint32(params.end_id)))
                size += len(held[-1])
                if size >= params.file_tokens:
                    yield flush()
                    ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    ordered = own.repartitionByRange("id").sortWithinPartitions("id")
    return staged(ordered.mapInArrow(run, _FILES), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    prepare(files.sparkSession)
    starts = staged(_running(files.select("part", "number", "n_tokens")), "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0), batch.column(1), strict=True):
                file = TokenFile(data.as_py())
                crc = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=file.doc_ids == NO_ID), pa.array(file.starts[:-1] + base.as_py()), pa.array(file.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(starts, ["part", "number"]).select("base", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _running(heads: DataFrame) -> DataFrame:
    """``base``: tokens of all files before each; a sum over parts, then within each, so that no task meets all files."""
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = heads.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # One row per part, whose number the session's shuffle partitions bound.
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("before"))
    return heads.join(before, "part").select("part", "number", (F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("base"))


def export_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each file's bytes as ``<part>-<number>.iktb`` into a mounted folder, complete or not at all."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            names = []
            for part, number, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                name = os.path.join(folder, f"{part.as_py():06d}-{number.as_py():06d}.iktb")
                unfinished = f"{name}.{uuid.uuid4().hex}"
                with open(unfinished, "wb") as out:
                    out.write(data.as_py())
                os.replace(unfinished, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return files.select("part", "number", "data").mapInArrow(run, "path string")
