"""Shared pieces of the training-data operators: shared-folder tables and batch text kernels.

The kernels work on Arrow string columns as raw UTF-8 bytes.  Words are maximal runs of bytes other than
space and \\t..\\r, which in UTF-8 are exactly the words ``[^\\x20\\x09-\\x0D]+``.  A null text is an empty text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import dealt, saved, shared_folder, work_path

#: Text bytes worked on at a time; a single longer text is still taken whole.
CHUNK_BYTES = 1 << 20
#: Ids of at most this number (8 bytes each) are broadcast to pick documents; more are joined by shuffle.
BROADCAST_IDS = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


__all__ = ["saved", "shared_folder", "work_path"]


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Estimated bytes of a table's columns for each part of a shuffle, and the most parts.
PART_BYTES, MOST_PARTS = 32 << 20, 100_000


def partitions(table: DataFrame) -> int:
    """Parts of a shuffle of a table: as many as the session has, and more where the table is estimated to need them."""
    spark = table.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, min(size // PART_BYTES, MOST_PARTS))  # tables without statistics count as endless


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunked(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + limit, side="right"))
        end = max(end, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of all batches of a task; at its end freed memory goes back, as the worker lives on."""
    for batch in batches:
        if batch.num_rows:
            yield from chunked(batch, column, limit)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such call, the memory stays for the next task
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes stay."""
    return _LOWER[raw]


class Words:
    """Words of a run of texts: ``begin``/``end`` byte places, ``first`` word of each text (n + 1), ``doc`` of each word.

    ``ink`` marks the bytes of words; other marks cut the texts into other runs, as into lines.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ink: np.ndarray | None = None):
        ink = ~_SPACE[raw] if ink is None else ink
        full = offsets[:-1] < offsets[1:]
        opens = ink.copy()
        opens[1:] &= ~ink[:-1]
        heads = offsets[:-1][full]
        opens[heads] = ink[heads]
        closes = ink.copy()
        closes[:-1] &= ~ink[1:]
        tails = offsets[1:][full] - 1
        closes[tails] = ink[tails]
        self.ink = ink
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.begin, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, raw: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return run_hashes(raw[self.ink], self.end - self.begin, seed)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(raw: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of consecutive runs of bytes; the runs have ``sizes`` of at least one and fill ``raw``."""
    global _POWERS
    if not len(sizes):
        return np.zeros(0, np.uint64)
    if len(_POWERS) < (most := int(sizes.max())):
        _POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, _MULT)]))
    heads = np.cumsum(sizes) - sizes
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(heads, sizes)
    sums = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1 + (seed << 8))) * _POWERS[place], heads)
    return mix(sums ^ (sizes.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) ^ np.uint64(seed))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` successive hashes (across texts too: mask those out)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = (total + hashes[i : i + n]) * _MULT
    return mix(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over [first[i], first[i + 1]) for each i, empty runs included."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[first[1:]] - total[first[:-1]]


def within(places: int, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of ``width`` over items dealt by ``first`` to texts: which lie in one text, and the first window of each text."""
    inside = np.ones(max(0, places - width + 1), bool)
    for i in range(1, width):
        at = first[1:-1] - i
        inside[at[(at >= 0) & (at < len(inside))]] = False
    counts = np.maximum(0, np.diff(first) - width + 1)
    return inside, np.concatenate([[0], np.cumsum(counts)])


def in_text(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal keys of one text."""
    return mix(keys + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
