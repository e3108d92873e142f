"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

The pieces and their log scores come from a model file whose path is a parameter.  A text gets one leading space, spaces
become the marker U+2581, and of all segmentations into pieces the one with the highest sum of scores is taken; of equals,
the one whose last piece begins first.  A character that no piece covers scores ten less than the worst piece and is
written as its UTF-8 bytes.  Decoding joins pieces and bytes (invalid UTF-8 becomes U+FFFD), turns markers into spaces and
drops the leading one, so a text comes back exactly unless it holds the marker itself, or a reserved piece's characters cannot occur.

No piece crosses from other characters into a marker, nor over a line feed, so a text is cut there and each segment is
looked up once per worker (``cache`` segments at most).

Defined cases: null and empty texts have no ids and decode to the empty text; every row gives a row, repeated ones too;
texts and words of any length are taken whole; an empty table gives an empty result; other columns of the input are neither
read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import prepare

MARK = "▁"
_SEGMENTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_PENALTY = 10.0
_SHORT, _PART = 1 << 12, 1 << 16  # bytes of a segment


@dataclass(frozen=True)
class PieceModel:
    """Pieces with scores, and their double-array trie over UTF-8 bytes (``base``, ``check``, ``value``)."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    worst: float

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a model file; the library only parses it."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = tuple(model.id_to_piece(i) for i in range(model.get_piece_size()))
        scores = tuple(float(model.get_score(i)) for i in range(len(pieces)))
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(pieces))]
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        return PieceModel.build(pieces, scores, [i for i in range(len(pieces)) if not special[i]], tuple(byte_ids[b] for b in range(256)))

    @staticmethod
    def build(pieces: tuple[str, ...], scores: tuple[float, ...], normal: list[int], byte_ids: tuple[int, ...]) -> PieceModel:
        for i in normal:
            if "\n" in pieces[i] or re.search(f"[^{MARK}]{MARK}", pieces[i]):
                raise ValueError(f"piece {i} crosses a segment: {pieces[i]!r}")
        base, check, value = _double_array({pieces[i].encode(): i for i in normal})
        return PieceModel(pieces, scores, byte_ids, base, check, value, min(scores[i] for i in normal))


def _double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States are slots; the child of ``s`` by byte ``c`` is ``base[s] + c + 1`` where ``check`` of that slot is ``s``."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, number in words.items():
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = number
    used = 1  # bit set of taken slots
    slot, base_of, check_of = {0: 0}, {}, {0: 0}
    for node, own in enumerate(children):
        if not own:
            continue
        taken = 0
        for c in own:
            taken |= used >> (c + 1)
        b = (~taken & (taken + 1)).bit_length() - 1  # the first offset at which all children find a free slot
        base_of[slot[node]] = b
        mark = 0
        for c, child in own.items():
            slot[child] = b + c + 1
            check_of[b + c + 1] = slot[node]
            mark |= 1 << (c + 1)
        used |= mark << b
    n = max(slot.values()) + 258
    base, check, value = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    base[list(base_of)] = list(base_of.values())
    check[list(check_of)] = list(check_of.values())
    for node, number in ends.items():
        value[slot[node]] = number
    return base, check, value


class Codec:
    """Encoder and decoder of one process."""

    def __init__(self, model: PieceModel, cache: int = 400_000):
        self.model, self.limit = model, cache
        self.base, self.check, self.value = model.base.tolist(), model.check.tolist(), model.value.tolist()
        self.known: dict[str, tuple[int, ...]] = {}
        self.out = [p.replace(MARK, " ").encode() for p in model.pieces]
        self.lengths = [len(p.encode()) for p in model.pieces]
        self.longest = max(self.lengths)
        for b, i in enumerate(model.byte_ids):
            self.out[i] = bytes([b])

    def segment(self, text: str) -> tuple[int, ...]:
        """The best segmentation of one segment."""
        data = text.encode()
        return self._word(data) if len(data) <= _SHORT else self._long(data)

    def _word(self, data: bytes) -> tuple[int, ...]:
        """A short segment, with plain lists."""
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.model.scores
        slots, unknown = len(check), self.model.worst - _PENALTY
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        back = [0] * (n + 1)
        i = 0
        while i < n:
            lead = data[i]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            score = best[i]
            single = False
            s, j = 0, i
            while j < n:
                t = base[s] + data[j] + 1
                if t >= slots or check[t] != s:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    total = score + scores[v]
                    held = best[j]
                    if held is None or total > held:
                        best[j] = total
                        back[j] = v
                    if j == i + step:
                        single = True
            if not single:
                i += step
                total = score + unknown
                held = best[i]
                if held is None or total > held:
                    best[i] = total
                    back[i] = -step
            else:
                i += step
        ids: list[int] = []
        at = n
        while at:
            v = back[at]
            if v >= 0:
                ids.append(v)
                at -= self.lengths[v]
            else:
                ids.extend(self.model.byte_ids[c] for c in reversed(data[at + v : at]))
                at += v
        ids.reverse()
        return tuple(ids)

    def _long(self, data: bytes) -> tuple[int, ...]:
        """A segment of any length.  Twelve bytes of state per byte of text; it is cut wherever no piece reaches over (every segmentation passes
        there), so that the state is that of a part."""
        n = len(data)
        base, check, value, scores, lengths = self.base, self.check, self.value, self.model.scores, self.lengths
        slots = len(check)
        unknown = self.model.worst - _PENALTY
        out: list[int] = []
        none = float("-inf")
        start = reach = i = 0
        size = min(n, _PART) + self.longest + 4
        best, back = array("d", [none]) * (size + 1), array("i", [0]) * (size + 1)
        best[0] = 0.0

        def trace(stop: int) -> None:
            ids: list[int] = []
            at = stop
            while at > start:
                v = back[at - start]
                if v >= 0:
                    ids.append(v)
                    at -= lengths[v]
                else:
                    ids.extend(self.model.byte_ids[c] for c in reversed(data[at + v : at]))
                    at += v
            out.extend(reversed(ids))

        while i < n:
            if i == reach and i - start >= _PART:  # every segmentation passes here
                trace(i)
                start = i
                best, back = array("d", [none]) * (size + 1), array("i", [0]) * (size + 1)
                best[0] = 0.0
            if i - start + self.longest + 4 >= len(best):
                best.extend(array("d", [none]) * len(best))
                back.extend(array("i", [0]) * len(back))
            lead = data[i]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            score = best[i - start]
            single = False
            s, j = 0, i
            while j < n:
                t = base[s] + data[j] + 1
                if t >= slots or check[t] != s:
                    break
                s = t
                j += 1
                v = value[s]
                if v >= 0:
                    total = score + scores[v]
                    if total > best[j - start]:
                        best[j - start] = total
                        back[j - start] = v
                        if j > reach:
                            reach = j
                    single = single or j == i + step
            if not single:
                total = score + unknown
                if total > best[i + step - start]:
                    best[i + step - start] = total
                    back[i + step - start] = -step
                    if i + step > reach:
                        reach = i + step
            i += step
        trace(n)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known
        out: list[int] = []
        for part in _SEGMENTS.findall((" " + text).replace(" ", MARK)):
            ids = known.get(part)
            if ids is None:
                ids = self.segment(part)
                if len(part) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[int, Codec] = {}


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", cache: int = 400_000) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids``, ``n_byte_tokens`` and ``round_trip`` (decoding gives the text back)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(PieceModel.load(model_path))  # the vocabulary: a parameter's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codec = _CODECS.get(id(model))
        if codec is None:
            _CODECS.clear()
            codec = _CODECS[id(model)] = Codec(model, cache)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_ids)] = True
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = part.column(1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                flat = np.array([i for x in ids for i in x], np.int32)
                ends = np.cumsum([0] + [len(x) for x in ids])
                sums = np.concatenate(([0], np.cumsum(is_byte[flat])))
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                    pa.array(np.diff(sums[ends]), pa.int64()),
                    pa.array([codec.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                ], ["id", "n_tokens", "ids", "n_byte_tokens", "round_trip"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(run, "id long, n_tokens long, ids array<int>, n_byte_tokens long, round_trip boolean").withColumnRenamed("id", id_col)
