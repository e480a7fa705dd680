"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A run of texts becomes one array of code points and one of their classes (letter, number, white space, other).  Each code point
maps the state before it (where the current run of one class began, and with what) to the state after it: either it keeps the
run or it starts one.  Such keep-or-restart functions compose associatively, so one scan (a running maximum of the places of
restarts) gives every code point its state, and the places where tokens begin follow from states of neighbours alone: a class
change begins a token, a space joins what follows it, the last of several white spaces parts from them, and an apostrophe that
begins a token takes a contraction's letters.  No regular expression is run.  The slices between these places are merged by the
vocabulary's ranks once for each different slice and then looked up; token ids and their byte offsets come back, from which
texts are decoded.

Defined results: a null or empty text has no ids; every text decodes to its own bytes; repeated rows are encoded each; null ids
are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, source_table, text_bytes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What an apostrophe takes along.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Slices kept by a worker before it starts anew, and the size from which a slice is merged with a heap.
KEEP, LONG = 600_000, 64


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def token_starts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Marks the code points at which a pre-token begins; ``heads`` are the first code points of the texts that have any."""
    n = len(points)
    kind = classes()[points]
    restart = np.ones(n, bool)
    restart[1:] = kind[1:] != kind[:-1]
    restart[heads] = True
    place = np.arange(n)
    run = np.maximum.accumulate(np.where(restart, place, 0))  # the scan: where each code point's run began
    starts = restart.copy()
    first = np.zeros(n, bool)
    first[heads] = True
    # a run of white space followed by something else in the same text gives up its last code point
    turn = np.flatnonzero(restart[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
    starts[turn - 1] = True
    starts[turn[points[turn - 1] == 0x20]] = False
    # contractions
    quote = np.flatnonzero((points == 0x27) & starts)
    last = np.append(heads, n)[np.searchsorted(heads, quote, side="right")] if len(quote) else quote
    done = np.zeros(len(quote), bool)
    for letters in CONTRACTIONS:
        size = len(letters)
        fits = ~done & (quote + size < last)
        for i, c in enumerate(letters):
            fits[fits] = points[quote[fits] + 1 + i] == ord(c)
        at = quote[fits] + 1
        starts[at] = False
        after = at + size
        inside = after < last[fits]
        more = after[inside]
        starts[more[kind[more] == LETTER]] = True
        done |= fits
    assert not n or (run <= place).all()
    return starts


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the neighbouring pair of least rank is merged, the leftmost first, until no pair has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG:
        return _merged_by_heap(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        least, at = min(((r, i) for i, r in enumerate(pair) if r is not None), default=(None, -1))
        if least is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Known(dict):
    """Numbers of slices; a new slice gets the next number and waits to be merged."""

    def __init__(self):
        self.waiting: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


class Encoded:
    """Ids of a run of texts: ``ids``, ``first`` id of each text (n + 1), and the byte ``offset`` of each id in its text."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, offset: np.ndarray):
        self.ids, self.first, self.offset = ids, first, offset

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.first[i] : self.first[i + 1]]


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = np.zeros(by_rank[-1][1] + 1, np.int64)
        self.size[[r for _, r in by_rank]] = [len(t) for t, _ in by_rank]
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = _Known(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        if new := self.known.waiting:
            found = [merged(p, self.ranks) for p in new]
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32)])
            self.known.waiting = []

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Ids of the texts whose UTF-8 bytes lie in ``raw`` between ``offsets``."""
        if len(self.known) > KEEP:
            self._forget()
        data = raw.tobytes()
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # bytes at which code points begin
        heads = np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])
        begin = at[token_starts(points, heads)]
        cuts = begin.tolist() + [len(data)]
        number = np.fromiter(map(self.known.__getitem__, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]), np.int64, len(begin))
        self._learn()
        source = self.ends[number]
        size = self.ends[number + 1] - source
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(source - total[:-1], size) + np.arange(total[-1])]
        first = total[np.searchsorted(begin, offsets)]
        ends = np.cumsum(self.size[ids])
        offset = ends - self.size[ids] - np.repeat(offsets[:-1], np.diff(first))
        return Encoded(ids, first, offset)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that runs of ids stand for."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.begin[ids] - total[:-1], size) + np.arange(total[-1])]
        return raw, total[first]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's own codec; its cache lives as long as the worker."""
    return Codec(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, "text"):
        e = codec(path).encode(*text_bytes(rows.column("text")))
        first = pa.array(e.first.astype(np.int32))
        yield pa.record_batch([rows.column("doc_id"), pa.ListArray.from_arrays(first, pa.array(e.ids.astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(e.offset.astype(np.int32)))], names=["doc_id", "ids", "offsets"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lists = rows.column("ids")
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        raw, at = codec(path).decode(lists.flatten().to_numpy(), first)
        data = raw.tobytes()
        yield pa.record_batch([rows.column("doc_id"), pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], names=["doc_id", "text"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, "text"):
        e = codec(path).encode(*text_bytes(rows.column("text")))
        raw, at = codec(path).decode(e.ids, e.first)
        hexed = lambda data, cuts: pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        yield pa.record_batch([rows.column("doc_id"), pa.array(np.diff(e.first).astype(np.int64)), hexed(e.ids.astype("<u4").tobytes(), 4 * e.first), hexed(raw.tobytes(), at)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, offsets: the token ids of each text and the byte at which each begins."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_encode, path=path), "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: what the ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes and digests of each text's ids and of what they decode to, encoded and decoded in one pass."""
    return _rows(docs, id_col, text_col).mapInArrow(partial(_digest, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(source_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
