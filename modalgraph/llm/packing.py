"""Packing of token pieces into sequences by repeated patterns fitted with non-negative least squares.

Documents are encoded once; only those longer than a sequence are cut, the first piece taking the remainder.  The histogram
of piece lengths (one count for each length, at most ``SIZE``) goes to the driver.  Patterns of a few lengths that fill a
sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded down,
and what the rounded patterns leave is packed by best fit on counts.  The plan is a list of rank intervals for each length:
its size depends on the number of lengths, not on the number of documents.  Pieces then find their place by their rank in
their length class, which is counted in two levels, so that no class of equal lengths has to meet in one task.

Defined results: a null or empty text is one piece, the end id; an empty table gives no rows; repeated rows are packed each;
null doc_ids are kept; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved, source_table
from .tokens import encoded

SIZE = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % size
    cuts = [0, *range(head or min(n, size), n + 1, size)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    for rows, ids in encoded(batches, tokenizer, end_id, "text"):
        out = [(d, i, a, n, zlib.crc32(x[a : a + n].astype("<u4"))) for d, x in zip(rows.column(0).to_pylist(), ids, strict=True) for i, (a, n) in enumerate(cut(len(x), size))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def patterns(histogram: dict[int, int], size: int = SIZE, wide: int = 6) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that fill a sequence exactly, or as nearly as the lengths allow.

    Each length is the largest of its pairs; threes and fours take their largest two from it and its ``wide`` most frequent
    partners of different sizes, and what best completes them.
    """
    have = np.array(sorted(n for n, c in histogram.items() if c and n < size))
    if not len(have):
        return []
    fits = np.zeros(size + 1, np.int64)  # the largest length up to each room
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    often = sorted(have.tolist(), key=lambda n: (-histogram[n], n))
    found: set[tuple[int, ...]] = set()
    for a in have.tolist():
        for seeds in [(), *((b,) for b in [*often[:wide], *have[:: max(1, len(have) // wide)].tolist()])]:
            room = size - a - sum(seeds)
            for _ in range(3 - len(seeds)):
                if room <= 0 or not (c := int(fits[room])):
                    break
                seeds, room = (*seeds, c), room - c
            if room >= 0 and seeds:
                found.add(tuple(sorted((a, *seeds), reverse=True)))
        k = size // a
        if 2 <= k <= 8:
            found.add((a,) * k)
    return sorted(found, reverse=True)  # those of long pieces are fitted first, as short ones fit anywhere


def fit(histogram: dict[int, int], rows: list[tuple[int, ...]], size: int = SIZE, sweeps: int = 25) -> list[int]:
    """Repeat counts by coordinate descent on ||A x - h||, x >= 0, rounded down so that no length is used beyond its count."""
    rest = np.zeros(size + 1)
    for n, c in histogram.items():
        if n < size:
            rest[n] = c
    left = rest.copy()
    parts = [np.unique(p, return_counts=True) for p in rows]
    x = np.zeros(len(rows))
    for _ in range(sweeps):
        moved = 0.0
        for j, (n, k) in enumerate(parts):
            step = max(-x[j], float(k @ rest[n]) / float(k @ k))
            if abs(step) > 1e-3:
                x[j] += step
                rest[n] -= k * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    out = []
    for j, (n, k) in enumerate(parts):
        times = int(min(np.floor(x[j] + 1e-9), *(left[n] // k)))
        left[n] -= k * times
        out.append(times)
    return out


def best_fit(left: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: (lengths, repeats) groups of equal sequences."""
    groups: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, count]
    done = []
    for n in sorted(left, reverse=True):
        c = left[n]
        for room in range(n, size + 1):
            while c and groups.get(room):
                lengths, count = groups[room].pop()
                k = min(room // n, c)
                bins = min(count, c // k)
                if bins < count:
                    groups[room].append([lengths, count - bins])
                groups[room - k * n].append([(*lengths, *[n] * k), bins])
                c -= bins * k
            if not c:
                break
        k = size // n
        for times, bins in ((k, c // k), (c % k, 1)):
            if times and bins:
                groups[size - times * n].append([(n,) * times, bins])
    for room in groups:
        done += [(tuple(x), b) for x, b in groups[room] if b]
    return done


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """All sequences as (lengths, repeats): the fitted patterns that leave at most one place, then best fit for the rest.

    Where few lengths occur, exact patterns can use up what the others need, so shares of the fitted counts are tried too, down to
    none, which is best fit alone; the share that makes the fewest sequences is taken, the largest of equal ones.
    """
    rows = patterns(histogram, size)
    fitted = [(p, t) for p, t in zip(rows, fit(histogram, rows, size), strict=True) if t and size - sum(p) <= 1]
    best: list[tuple[tuple[int, ...], int]] | None = None
    for quarters in (4, 3, 2, 1, 0):
        chosen = [(p, t * quarters // 4) for p, t in fitted if t * quarters // 4]
        left = {n: c for n, c in histogram.items() if c}
        for p, t in chosen:
            for n in p:
                left[n] -= t
        found = chosen + best_fit({n: c for n, c in left.items() if c}, size)
        if best is None or sum(t for _, t in found) < sum(t for _, t in best):
            best = found
    return best or []


def intervals(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) in order of rank."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    base = 0
    for lengths, times in sequences:
        at = 0
        for n in lengths:
            out[n].append((used[n], base, at))
            used[n] += times
            at += n
        base += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def _place(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            t = table[int(length[own[0]])]
            k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
            sequence[own], offset[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.record_batch([*(rows.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of each piece among those of its length, from 0, counted in dealt buckets."""
    n = partitions(pieces)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("many"))
    before = F.sum("many").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = saved(rows.mapInArrow(partial(_pieces, tokenizer=tokenizer, end_id=end_id, size=size), PIECES), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = intervals(plan(histogram, size))
    return ranked(pieces).mapInArrow(partial(_place, table=table), PIECES + ", sequence_id long, offset long")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(source_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
