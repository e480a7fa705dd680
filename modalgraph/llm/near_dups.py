"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

A text's shingles are its windows of ``SHINGLE`` words (A-Z lower-cased), weighted by how often they occur; a text of fewer
words is one shingle.  Each shingle is a Poisson process of its weight as rate: its arrivals fall on random registers, a
register keeps the shingle that arrived first, and a process ends when it can no longer come first anywhere.  Two texts agree
on a register with the probability Jaccard similarity of their weighted shingles.  Bands of registers are hashed to buckets.

Texts with equal word sequences are merged first, so a group of copies is one text from then on.  Every text of a bucket is
compared with the bucket's least id.  Buckets whose other texts are then not yet in one class let a few more of their texts meet
those of other classes.  What is still open after that is compared in full: the texts outside a bucket's largest class, in
blocks, meet all texts of the bucket, and a task returns no pairs but the few links that join classes.  So no link between
bucket mates is lost, and a task holds a block and a part of a bucket.  That is done in buckets of at most ``MOST`` texts, so rows
grow with the texts.  The texts of larger ones meet by the rarest of their shingles: two texts can only be similar if the rarest
shingle they share is among the first of each one's shingles, by rarity, that make up 1 - ``SIMILARITY`` of its weight.  Texts with
one such shingle make a group in the place of a bucket, so texts that only share frequent passages do not meet.  A comparison
computes the similarity of all shingles and links at ``SIMILARITY`` or more; classes are the connected components of the links.

Defined results: texts without words (null texts included) are copies of each other; the class id is the least doc_id of the
class; rows with a null doc_id take the class of their copies, or null; repeated rows of one doc_id are one document to
``classes``, while ``keep`` leaves one row of each class, whatever the ids; an empty table gives no rows; other columns are ignored
by ``classes`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Words, chunks, lowered, mix, partitions, saved, source_table, text_bytes, window_hashes, within

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
#: Comparisons with one text are dealt to a task of their own for each so many.
PER_TASK = 512
#: Rounds in which one more text of each open bucket meets the texts of other classes in it.
LEADERS = 2
#: Texts of a block when classes of a bucket are compared.
BLOCK = 256
#: Texts of an open bucket that are all compared; those of larger buckets are grouped by their rarest shingles.
MOST = 1_024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


class Shingles:
    """Weighted shingles of a run of texts, by text and then by hash: ``key``, ``doc``, ``weight``, ``first`` (n + 1)."""

    def __init__(self, column: pa.Array, width: int = SHINGLE):
        raw, offsets = text_bytes(column)
        words = Words(raw, offsets)
        hashes = words.hashes(lowered(raw))
        n = len(words.count)
        inside, _ = within(len(hashes), words.first, width)
        windows = window_hashes(hashes, width)[inside]
        docs = words.doc[: len(inside)][inside]
        self.identity = np.zeros((2, n), np.uint64)
        some = words.count > 0
        if some.any():
            place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.count)).astype(np.uint64)
            for i in range(2):
                placed = mix(hashes + _SEEDS[i]) * (np.uint64(2) * mix(place + np.uint64(i)) + np.uint64(1))
                self.identity[i, some] = mix(np.add.reduceat(placed, words.first[:-1][some]) + words.count[some].astype(np.uint64))
        short = np.flatnonzero(some & (words.count < width))
        key, doc = np.concatenate([windows, self.identity[0, short]]), np.concatenate([docs, short])
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
        self.key, self.doc = key[heads], doc[heads]
        self.weight = np.diff(np.append(heads, len(key))).astype(np.float64)
        self.first = np.searchsorted(self.doc, np.arange(n + 1))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[i], self.first[i + 1]
        return self.key[a:b], self.weight[a:b]


def probminhash(key: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """An n x m array of the elements that arrive first at each register; texts without elements keep zeros."""
    soonest, winner = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, arrival, block = np.zeros(len(key)), 0, 1
    while len(key):
        number = np.arange(arrival, arrival + block, dtype=np.uint64)
        draw = mix(key[:, None] + (np.uint64(2) * number + np.uint64(1)) * _ODD)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = time[:, None] + np.cumsum(gap, 1)
        register = (mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        slot = (doc[:, None] * m + register).ravel()
        flat, who = times.ravel(), np.repeat(key, block)
        hopeful = flat < soonest[slot]
        slot, flat, who = slot[hopeful], flat[hopeful], who[hopeful]
        np.minimum.at(soonest, slot, flat)
        won = soonest[slot] == flat
        winner[slot[won]] = who[won]
        latest = soonest.reshape(n, m).max(1)
        going = times[:, -1] < latest[doc]
        key, doc, weight, time = key[going], doc[going], weight[going], times[going, -1]
        arrival += block
        block = max(1, min(64, arrival, (1 << 20) // max(1, len(key))))
    return winner.reshape(n, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared x of 1 / sum over all y of max(a[y] / a[x], b[y] / b[x]); keys come sorted."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    x, y = wa[both], wb[at[both]]
    if not len(x):
        return 0.0
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    above = only_a + np.cumsum(x)  # those of at least this ratio count by a, the others by b
    below = only_b + y.sum() - np.cumsum(y)
    return float((1 / (above / x + below / y)).sum())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = BANDS * ROWS
    for rows in chunks(batches, "text"):
        s = Shingles(rows.column("text"))
        n = rows.num_rows
        winner = probminhash(s.key, s.doc, s.weight, n, m).reshape(n, BANDS, ROWS)
        band = np.zeros((n, BANDS), np.uint64) + mix(np.arange(BANDS, dtype=np.uint64))
        for i in range(ROWS):
            band = mix(band * _ODD + winner[:, :, i])
        full = np.diff(s.first) > 0
        bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(band.ravel().view(np.int64)), mask=pa.array(~full))
        yield pa.record_batch([rows.column("doc_id"), *(pa.array(k.view(np.int64)) for k in s.identity), bands], names=["doc_id", "k1", "k2", "bands"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by center, its own text first; holds one center's shingles."""
    at, own = None, None
    for rows in chunks(batches, "text"):
        s = Shingles(rows.column("text"))
        links = []
        for i, (center, member) in enumerate(zip(rows.column("center").to_pylist(), rows.column("member").to_pylist(), strict=True)):
            if member is None:
                at, own = center, s.of(i)
            elif center == at and probability_jaccard(own, s.of(i)) >= SIMILARITY - 1e-9:
                links.append((center, member))
        yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def picked(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents whose doc_id is (or, with left_anti, is not) among ``ids`` (one column doc_id, distinct)."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of distinct pairs (center, member) those that are similar, as (a, b)."""
    salt: Column = F.pmod(F.xxhash64("member"), F.col("tasks"))
    sized = pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("tasks"))
    members = pairs.join(sized, "center").select("center", salt.cast("int").alias("salt"), "member").join(texts.withColumnRenamed("doc_id", "member"), "member").select("center", "salt", "member", "text")
    centers = sized.join(texts.withColumnRenamed("doc_id", "center"), "center").select("center", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "text")
    dealt = centers.union(members).repartition(partitions(texts), "center", "salt").sortWithinPartitions("center", "salt", F.col("member").asc_nulls_first())
    return dealt.select("center", "member", "text").mapInArrow(_compare, "a long, b long")


def _joining(block: list[tuple[int, str, int, str]]) -> list[tuple[int, int]]:
    """Links between different classes of two blocks of texts (side, class, id, text): of each two classes at most one.

    Shared shingles are counted for all pairs at once, which is the similarity where no shingle repeats in a text; where some
    do, pairs are compared by weight until their classes are joined.
    """
    side, label, rep, text = zip(*block, strict=True)
    s, side = Shingles(pa.array(text, pa.string())), np.array(side)
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    _, which, many = np.unique(s.key, return_inverse=True, return_counts=True)
    both = many[which] > 1
    columns, doc = np.unique(which[both], return_inverse=True)[1], s.doc[both]
    shared, wide = np.zeros((len(a), len(b)), np.float32), max(1, (2 << 20) // len(block))
    for low in range(0, int(columns.max(initial=-1)) + 1, wide):
        own = (columns >= low) & (columns < low + wide)
        table = np.zeros((len(block), wide), np.float32)
        table[doc[own], columns[own] - low] = 1
        shared += table[a] @ table[b].T
    size = np.diff(s.first).astype(np.float32)
    alike = shared / np.maximum(1, size[a][:, None] + size[b][None, :] - shared)
    plain = np.array([s.of(i)[1].max(initial=1) == 1 for i in range(len(block))])
    names = np.unique(np.array(label), return_inverse=True)[1]
    root = list(range(int(names.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    exact = plain[a][:, None] & plain[b][None, :]
    rows, cols = np.nonzero((shared > 0) & (names[a][:, None] != names[b][None, :]) & (~exact | (alike >= SIMILARITY - 1e-6)))
    links = []
    for k in np.argsort(-alike[rows, cols], kind="stable").tolist():
        i, j = int(a[rows[k]]), int(b[cols[k]])
        x, y = find(int(names[i])), find(int(names[j]))
        if x != y and (exact[rows[k], cols[k]] or probability_jaccard(s.of(i), s.of(j)) >= SIMILARITY - 1e-9):
            root[x] = y
            links.append((rep[i], rep[j]))
    return links


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and block: first the block (side 0), then what it is compared with, taken by ``BLOCK`` texts."""
    at, block, chunk = None, [], []

    def done() -> pa.RecordBatch:
        links = _joining(block + chunk) if block and chunk else []
        chunk.clear()
        return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for rows in batches:
        keys = zip(rows.column("bucket").to_pylist(), rows.column("block").to_pylist(), strict=True)
        for key, *row in zip(keys, *(rows.column(c).to_pylist() for c in ("side", "label", "rep", "text")), strict=True):
            if key != at:
                yield done()
                at, block = key, []
            (chunk if row[0] else block).append(tuple(row))
            if len(chunk) == BLOCK:
                yield done()
    yield done()


def _open(mates: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, rep, label) of the buckets with texts of different classes; of buckets with the same texts only one."""
    placed = _labelled(mates.select("bucket", "rep"), labels)
    seen = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.sum(F.hash("rep").cast("long")).alias("h2"))
    once = seen.filter("low != high").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return saved(placed.join(once, "bucket", "left_semi").select("bucket", "rep", "label"), "open-buckets")


def across_classes(mates: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join classes within buckets; mates as (bucket, rep, label).

    The texts outside a bucket's largest class, in blocks, meet all texts of the bucket.
    """
    largest = mates.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"))
    outside = mates.join(largest, "bucket").filter(F.col("label") != F.col("top.label")).select("bucket", "rep", "label")
    blocks = outside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    held = outside.join(blocks, "bucket").select("bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "label", "rep")
    met = mates.join(blocks, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "label", "rep")
    rows = held.union(met).join(texts.withColumnRenamed("doc_id", "rep"), "rep").repartition(partitions(texts), "bucket", "block").sortWithinPartitions("bucket", "block", "side", "rep")
    return rows.mapInArrow(_compare_blocks, "a long, b long")


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, key, share): the shingles of each text and the share of its weight that each has."""
    for rows in chunks(batches, "text"):
        s = Shingles(rows.column("text"))
        whole = np.bincount(s.doc, s.weight, rows.num_rows)
        yield pa.record_batch([rows.column("rep").take(pa.array(s.doc)), pa.array(s.key.view(np.int64)), pa.array(s.weight / whole[s.doc])], names=["rep", "key", "share"])


def rarest(texts: DataFrame) -> DataFrame:
    """(bucket, rep): the shingles, as buckets, by which texts (rep, text) meet if they are similar.

    The similarity of two texts is at most the sum over shingles of the lesser share.  So at ``SIMILARITY`` the shingles of a text
    before the first one, by rarity, that both have weigh no more than 1 - ``SIMILARITY``.
    """
    weighed = saved(texts.mapInArrow(_weigh, "rep long, key long, share double"), "shingles")
    often = weighed.groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    before = F.sum("share").over(Window.partitionBy("rep").orderBy("texts", "key").rowsBetween(Window.unboundedPreceding, -1))
    ranked = weighed.join(often, "key").select("rep", "key", "texts", F.coalesce(before, F.lit(0.0)).alias("before"))
    return ranked.filter((F.col("before") <= 1 - SIMILARITY + 1e-9) & (F.col("texts") > 1)).select(F.col("key").alias("bucket"), "rep")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of the links (a, b), for the nodes that have links.

    Rounds of least neighbour labels and label jumping; each round is written to the shared folder.
    """
    edges = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("low"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, labels.node == near.a).join(hop, "label").select("node", "label", F.least("label", "low", "jump").alias("next"))
        new = saved(new, "labels")
        labels = new.select("node", F.col("next").alias("label"))
        if not new.filter("label != next").limit(1).count():
            return labels


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: one row for each document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = saved(rows.mapInArrow(_sign, "doc_id long, k1 long, k2 long, bands array<long>"), "signatures")
    copies = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    merged = saved(signed.join(copies, ["k1", "k2"]).select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "copies")
    buckets = merged.filter(F.col("bands").isNotNull()).select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    mates = saved(buckets.join(shared, "bucket").select("bucket", "center", "rep"), "mates")
    texts = saved(picked(rows, mates.select(F.col("rep").alias("doc_id")).distinct()).dropDuplicates(["doc_id"]), "mate-texts")
    first = mates.filter("rep != center").select("center", F.col("rep").alias("member")).distinct()
    links = saved(compared(first, texts), "links")
    labels = components(links)
    rest = _open(mates.filter("rep != center"), labels)  # a center has met all its bucket
    for i in range(LEADERS):
        if not rest.limit(1).count():
            break
        leaders = rest.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(i)).alias("h"), "rep", "label")).alias("leader"))
        led = rest.join(leaders, "bucket")
        pairs = led.filter(F.col("label") != F.col("leader.label")).select(F.col("leader.rep").alias("center"), F.col("rep").alias("member")).distinct()
        links = saved(links.union(compared(pairs, texts)), "links")
        labels = components(links)
        rest = _open(led.filter(F.col("rep") != F.col("leader.rep")), labels)
    if rest.limit(1).count():
        large = saved(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST).select("bucket"), "large-buckets")
        links = links.union(across_classes(rest.join(large, "bucket", "left_anti"), texts))
        if large.limit(1).count():
            own = rest.join(large, "bucket", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
            met = saved(rarest(picked(texts, own).withColumnRenamed("doc_id", "rep")), "rarest")
            links = links.union(across_classes(_open(met, labels), texts))
        labels = components(links)
    return _labelled(merged.select("doc_id", "rep"), labels).select("doc_id", F.col("label").alias("class_id"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one of the least id, with all columns.

    Where ids are null or repeated, rows get numbers of their own, in a table, and of each class one row of the least id stays.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    seen = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not seen.limit(1).count():
        found = saved(classes(docs, id_col, text_col), "classes")
        gone = found.filter("doc_id != class_id").select(F.col("doc_id").alias("__gone"))
        few = gone.count() <= BROADCAST_IDS
        return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
    rows = saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = classes(rows, "__row", text_col).join(rows.select(F.col("__row").alias("doc_id"), F.col(id_col).cast("long").alias("id")), "doc_id")
    first = saved(found.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("least")).select(F.col("least.doc_id").alias("__row")), "first-rows")
    few = first.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(first) if few else first, "__row", "left_semi").select(docs.columns)


def op5_near_dups(spark, sf_dir: str) -> DataFrame:
    return classes(source_table(spark, sf_dir, "documents"))
