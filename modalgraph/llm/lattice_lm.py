"""Language-model scoring by subword lattices.

The pieces of an existing vocabulary, each with a probability of its own, spell words after a word-start mark.  A word can be
spelled by many piece sequences: a forward recursion in log space adds up the probabilities of all its segmentations.  A word
seen in training is one more piece of the lattice, with its discounted frequency; what the discount leaves over weighs the other
segmentations, so a word's probability is the sum over all ways to write it, as one piece or as many.  A text's probability is the
product over its words and the end.  Characters that are no piece are spelled by bytes.  Piece probabilities start from the order
of the vocabulary's own scores and are re-estimated by expectation-maximisation (forward-backward) over the different training
words, as it is new words that they have to spell.

Corpora mix languages and styles, so there are a few classes of texts, each with probabilities of its own: a mixture of word
multinomials is fitted to all training texts, from starting points in a bounded sample (``SAMPLE`` at most, chosen by hash).
Training texts count for each class as much as they belong to it, and the score of a text is the log of the sum over classes of
the class's probability times that of the text in it.  Classes to which a text belongs by less than ``LEAST`` are no part of it.
All counts cover all texts.

Words are counted and scored once for each class, in a table dealt by word.  Words that make up at least 1 / ``FREQUENT`` of all
words, of which there can be no more than ``FREQUENT``, are scored where the text is; the other words of each text meet the
table in a join whose keys are therefore never hot.  Words are joined by a 64-bit hash.

Beside the model's score there is a base score: add-one smoothed word frequencies of the training texts.

Defined results: a null or empty text is the end alone; a null doc_id counts as the empty id text and is in training; repeated
rows are scored each; with no training text every word is unknown and pieces keep their first probabilities; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, chunks, lowered, mix, saved, source_table, sums, text_bytes

#: ``PRIOR``: uses of pieces, by their first probabilities, that are added to those of the training words.
FREQUENT, ROUNDS, PRIOR, DISCOUNT = 500_000, 2, 200.0, 0.75
#: Classes of texts, buckets of their words, and texts of the sample in which the classes start.
CLASSES, BUCKETS, SAMPLE = 12, 1 << 12, 2_000
#: The classes start from the best of so many fits to the sample; each is fitted until the likelihood rises by less than a share of it.
STARTS, TOLERANCE, FITS = 8, 1e-4, 25
#: The least share by which a text belongs to a class.
LEAST = 1e-3
FOLDS, HELD_OUT = 7, 2
#: The mark of a word's start in the vocabulary's pieces.
START = "▁"
_STEP, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """An existing subword vocabulary: piece texts in order of their scores, with a vectorised lookup of code-point runs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        kept = [(model.get_score(i), model.id_to_piece(i)) for i in usual]
        kept = [(s, p) for s, p in kept if START not in p[1:]]
        self.text = [p for _, p in sorted(kept, key=lambda x: (-x[0], x[1]))]
        self.n, self.longest = len(self.text), max(map(len, self.text))
        self.byte, self.end = self.n, self.n + 1
        size = np.array([len(p) for p in self.text])
        codes = np.zeros((self.n, self.longest), np.uint64)
        codes[np.arange(self.longest) < size[:, None]] = np.frombuffer("".join(self.text).encode("utf-32-le"), np.uint32)
        hashes = np.zeros(self.n, np.uint64)
        for i in range(self.longest):
            hashes = np.where(i < size, hashes * _STEP + codes[:, i] + np.uint64(1), hashes)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.likely = np.zeros(1 << 20, bool)
        self.likely[(hashes * _SPREAD) >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, piece) of the hashes that are pieces."""
        which = np.flatnonzero(self.likely[(hashes * _SPREAD) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[which]), self.n - 1)
        real = self.hashes[at] == hashes[which]
        return which[real], self.ids[at[real]]

    def first_logs(self) -> np.ndarray:
        """Natural logs by order alone: a Zipf law over the pieces, a small share for bytes and the end."""
        share = np.append(1 / (np.arange(self.n) + 10.0), [0.0, 0.0])
        share = 0.98 * share / share.sum()
        share[self.byte] = share[self.end] = 0.01
        return np.log(share)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattice:
    """All segmentations of words of one length: edges (start, size, rows, pieces, bytes)."""

    def __init__(self, codes: np.ndarray, table: Pieces):
        self.n, self.length = codes.shape
        self.codes, self.table, self.edges = codes, table, []
        for i in range(self.length):
            h = np.zeros(self.n, np.uint64)
            for k in range(1, min(table.longest, self.length - i) + 1):
                h = h * _STEP + codes[:, i + k - 1].astype(np.uint64) + np.uint64(1)
                rows, ids = table.find(h)
                if k == 1 and len(rows) < self.n:
                    bare = np.ones(self.n, bool)
                    bare[rows] = False
                    other = np.flatnonzero(bare)
                    c = codes[other, i]
                    self.edges.append((i, 1, other, None, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                if len(rows):
                    self.edges.append((i, k, rows, ids, None))

    def _log(self, edge: tuple, logs: np.ndarray) -> np.ndarray:
        return logs[edge[3]] if edge[3] is not None else edge[4] * (logs[self.table.byte] - math.log(256))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """alpha[row, place]: the log probability of all ways to spell what is before a place."""
        alpha = np.full((self.n, self.length + 1), -np.inf)
        alpha[:, 0] = 0
        for e in self.edges:
            i, k, rows = e[:3]
            alpha[rows, i + k] = np.logaddexp(alpha[rows, i + k], alpha[rows, i] + self._log(e, logs))
        return alpha

    def expected(self, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, each word counting ``weight`` times; words too unlikely for plain products are worked on in logs."""
        rate, byte = np.exp(logs), math.exp(logs[self.table.byte] - math.log(256))
        alpha, beta, uses = np.zeros((self.length + 1, self.n)), np.zeros((self.length + 1, self.n)), np.zeros(len(logs))
        alpha[0] = beta[-1] = 1
        for i, k, rows, ids, size in self.edges:
            alpha[i + k][rows] += alpha[i][rows] * (byte**size if ids is None else rate[ids])
        faint = alpha[-1] < 1e-250
        scale = np.where(faint, 0, weight / np.where(faint, 1, alpha[-1]))
        for i, k, rows, ids, size in reversed(self.edges):
            after = beta[i + k][rows] * (byte**size if ids is None else rate[ids])
            beta[i][rows] += after
            share = alpha[i][rows] * after * scale[rows]
            if ids is None:
                uses[self.table.byte] += float((share * size).sum())
            else:
                np.add.at(uses, ids, share)
        return uses + Lattice(self.codes[faint], self.table).expected_by_logs(logs, weight[faint]) if faint.any() else uses

    def expected_by_logs(self, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The same for words of any length."""
        alpha = self.forward(logs)
        beta = np.full(alpha.shape, -np.inf)
        beta[:, -1] = 0
        uses = np.zeros(len(logs))
        for e in reversed(self.edges):
            i, k, rows, ids, size = e
            log = self._log(e, logs) + beta[rows, i + k]
            beta[rows, i] = np.logaddexp(beta[rows, i], log)
            share = np.exp(alpha[rows, i] + log - alpha[rows, -1]) * weight[rows]
            if ids is None:
                uses[self.table.byte] += float((share * size).sum())
            else:
                np.add.at(uses, ids, share)
        return uses


def lattices(words: list[str], table: Pieces) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places in the list, lattice) for each length of word; at most so many words at a time that edges stay small."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        step = max(1, 100_000 // (n + 1))
        for a in range(0, len(same), step):
            own = same[a : a + step]
            codes = np.frombuffer("".join(START + words[i] for i in own.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n + 1)
            yield own, Lattice(codes, table)


def word_logs(words: list[str], table: Pieces, logs: np.ndarray) -> np.ndarray:
    """Natural log probability of each word."""
    out = np.zeros(len(words))
    for own, lattice in lattices(words, table):
        out[own] = lattice.forward(logs)[:, -1]
    return out


class Bags:
    """Bags of buckets of a run of texts: ``at`` and ``n``, the buckets of a text and their counts, ``first`` of each text (n + 1)."""

    def __init__(self, at: np.ndarray, n: np.ndarray, first: np.ndarray):
        self.at, self.n, self.first = at, n.astype(np.float64), first
        self.doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

    @classmethod
    def of(cls, packed: list[bytes]) -> Bags:
        """Of runs of texts that ``packed`` made."""
        if not packed:
            return cls(np.zeros(0, np.uint16), np.zeros(0), np.zeros(1, np.int64))
        at, n, sizes = [], [], []
        for data in packed:
            texts, many = np.frombuffer(data, "<i8", 2)
            sizes.append(np.frombuffer(data, "<u4", texts, 16))
            n.append(np.frombuffer(data, "<u4", many, 16 + 4 * texts))
            at.append(np.frombuffer(data, "<u2", many, 16 + 4 * texts + 4 * many))
        return cls(np.concatenate(at), np.concatenate(n), np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)]))

    def packed(self, begin: int, end: int) -> bytes:
        """The bags of the texts from ``begin`` up to ``end`` as bytes."""
        a, b = self.first[begin], self.first[end]
        return np.array([end - begin, b - a], "<i8").tobytes() + np.diff(self.first[begin : end + 1]).astype("<u4").tobytes() + self.n[a:b].astype("<u4").tobytes() + self.at[a:b].astype("<u2").tobytes()

    def dense(self) -> np.ndarray:
        counts = np.zeros((len(self.first) - 1, BUCKETS), np.float32)
        counts[self.doc, self.at] = self.n
        return counts

    def logs(self, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Of each class and text the log of both."""
        return np.stack([sums(row[self.at] * self.n, self.first) + p for row, p in zip(logs, prior, strict=True)])

    def expected(self, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """A row for each class: expected texts, expected words of each bucket, and of all texts the log of their probability, in the first row."""
        post, total = self.logs(logs, prior), np.zeros((len(prior), 2 + BUCKETS))
        if post.shape[1]:
            top = post.max(0)
            post = np.exp(post - top)
            all_ = post.sum(0)
            post /= all_
            total[0, -1] = (top + np.log(all_)).sum()
            total[:, 0] = post.sum(1)
            for row, share in zip(total, post, strict=True):
                row[1:-1] = np.bincount(self.at, self.n * share[self.doc], BUCKETS)
        return total


class Mixture:
    """Classes of texts: a multinomial over hashed words for each."""

    def __init__(self, sample: Bags, k: int = CLASSES, expect: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """Fits to these texts, or where they are a sample to the texts over which ``expect`` gives what ``expected`` does.

        Starts from the best of ``STARTS`` fits to the sample, each from texts drawn for being long and unlike those drawn before.
        """
        self.prior, self.logs = np.zeros(1), np.full((1, BUCKETS), -math.log(BUCKETS))
        counts = sample.dense()
        if not len(counts):
            return
        unit, length, draw = counts / np.maximum(1e-9, np.linalg.norm(counts, axis=1, keepdims=True)), np.minimum(counts.sum(1), 500) + 1e-3, np.random.default_rng(0)
        best = -math.inf
        for _ in range(STARTS):
            chosen, nearest = [], np.zeros(len(counts))
            while len(chosen) < min(k, len(counts)):
                weight = np.maximum(1 - nearest, 1e-6) ** 2 * length
                weight[chosen] = 0
                chosen.append(int(draw.choice(len(counts), p=weight / weight.sum())))
                nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
            found = self._fitted(np.full(len(chosen), 1 / len(chosen)), counts[chosen] + counts.mean(0) + 1e-3, sample.expected)
            if found[0] > best:
                best, prior, share = found
        if expect:
            _, prior, share = self._fitted(prior, share, expect)
        self.prior, self.logs = np.log(prior), np.log(share / share.sum(1, keepdims=True))

    @staticmethod
    def _fitted(prior: np.ndarray, share: np.ndarray, expect: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """(log likelihood, class probabilities, expected words) once the likelihood hardly rises."""
        before = -math.inf
        for _ in range(FITS):
            total = expect(np.log(share / share.sum(1, keepdims=True)), np.log(prior))
            texts, likelihood = total[:, 0], total[0, -1]
            prior, share = (texts + 1) / (texts.sum() + len(texts)), total[:, 1:-1] + 0.1
            if likelihood - before < TOLERANCE * abs(likelihood):
                break
            before = likelihood
        return likelihood, prior, share

    def shares(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How far each text, of the hashes of its words, belongs to each class: a row for each class."""
        bags = Bags((hashes % np.uint64(BUCKETS)).astype(np.int64), np.ones(len(hashes)), first)
        post = bags.logs(self.logs, self.prior)
        post = np.exp(post - post.max(0))
        post /= post.sum(0)
        post[post < LEAST] = 0
        return post / post.sum(0)


def _keys(hashes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Hashes of words within classes."""
    return mix(hashes + (kind.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))


def _bags(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    """The bags of a chunk of texts in one row without a key, and each of those in the sample in a row with its key."""
    for rows in chunks(batches, "text"):
        raw, offsets = text_bytes(rows.column("text"))
        words = Words(raw, offsets)
        bucket = (words.hashes(lowered(raw)) % np.uint64(BUCKETS)).astype(np.int64)
        met, n = np.unique(words.doc * BUCKETS + bucket, return_counts=True)
        bags = Bags((met % BUCKETS).astype(np.uint16), n, np.searchsorted(met, np.arange(rows.num_rows + 1) * BUCKETS))
        key = rows.column("key").to_numpy()
        some = np.flatnonzero(key <= cut).tolist()
        yield pa.record_batch([pa.array([None, *key[some].tolist()], pa.int64()), pa.array([bags.packed(0, rows.num_rows), *(bags.packed(i, i + 1) for i in some)], pa.binary())], names=["key", "bags"])


def _expect_classes(batches: Iterator[pa.RecordBatch], logs: np.ndarray, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row with the expected texts and words of a task."""
    least = logs - logs.max(0)  # only differences of classes matter to the shares; the rest is added to the likelihood below
    total = np.zeros((len(prior), 2 + BUCKETS))
    for rows in batches:
        for data in rows.column("bags"):
            bags = Bags.of([data.as_py()])
            total += bags.expected(least, prior)
            total[0, -1] += float((logs.max(0)[bags.at] * bags.n).sum())
    yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for rows in batches:
        for x in rows.column("sums"):
            got = np.frombuffer(x.as_buffer())
            total = got.copy() if total is None else total + got
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def fit_classes(rows: DataFrame, sample: int = SAMPLE) -> Mixture:
    """Classes of all training texts among (doc_id, text, training)."""
    trained = rows.filter("training").select(F.xxhash64("doc_id").alias("key"), "text")
    first = trained.select("key").orderBy("key").limit(sample + 1).toArrow().column("key").to_pylist()
    bags = saved(trained.mapInArrow(partial(_bags, cut=first[:sample][-1] if first else -(1 << 63)), "key bigint, bags binary"), "bags")
    got = bags.filter("key is not null").orderBy("key", F.xxhash64("bags"), "bags").limit(sample).collect()
    starts = Bags.of([r["bags"] for r in got])
    if len(first) <= sample:
        return Mixture(starts)
    parts = math.isqrt(bags.rdd.getNumPartitions()) + 1

    def expect(logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
        of_tasks = bags.filter("key is null").select("bags").mapInArrow(partial(_expect_classes, logs=logs, prior=prior), "sums binary")
        return sum(np.frombuffer(r["sums"]) for r in of_tasks.repartition(parts).mapInArrow(_add, "sums binary").collect()).reshape(len(prior), -1)

    return Mixture(starts, expect=expect)


class Placed:
    """Words of a run of texts within the classes that their texts belong to: a pair is a text in a class.

    ``text``, ``kind`` and ``share`` of each pair; ``word``, ``pair`` of each word in it, and its ``key``; ``first`` word of each pair.
    """

    def __init__(self, words: Words, plain: np.ndarray, mixture: Mixture):
        shares = mixture.shares(plain, words.first).T
        self.text, self.kind = np.nonzero(shares)
        self.share = shares[self.text, self.kind]
        count = words.count[self.text]
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.pair = np.repeat(np.arange(len(count)), count)
        self.word = np.arange(len(self.pair)) - np.repeat(self.first[:-1] - words.first[self.text], count)
        self.key = _keys(plain[self.word], self.kind[self.pair])


def _count(batches: Iterator[pa.RecordBatch], mixture: Mixture) -> Iterator[pa.RecordBatch]:
    """Different words of each class in a chunk with their counts in all and in training texts; ends as empty words."""
    for rows in chunks(batches, "text"):
        raw, offsets = text_bytes(rows.column("text"))
        raw = lowered(raw)
        words = Words(raw, offsets)
        plain = words.hashes(raw)
        placed = Placed(words, plain, mixture)
        keys, at, which = np.unique(placed.key, return_index=True, return_inverse=True)
        trained = rows.column("training").to_numpy(zero_copy_only=False)[placed.text] * placed.share
        begin, end, of_word = words.begin[placed.word[at]], words.end[placed.word[at]], placed.kind[placed.pair[at]]
        data = raw.tobytes()
        text = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ends = np.unique(placed.kind)
        key = np.concatenate([keys, _keys(np.zeros(len(ends), np.uint64), ends)]).view(np.int64)
        hashes = np.concatenate([plain[placed.word[at]], np.zeros(len(ends), np.uint64)]).view(np.int64)
        n = np.concatenate([np.bincount(which, minlength=len(keys)), np.bincount(placed.kind)[ends]])
        c = np.concatenate([np.bincount(which, trained[placed.pair], len(keys)), np.bincount(placed.kind, trained)[ends]])
        yield pa.record_batch([pa.array(key), pa.array(hashes), pa.array(np.concatenate([of_word, ends]).astype(np.int32)), pa.array([*text, *[b""] * len(ends)], pa.binary()).cast(pa.string()), pa.array(n), pa.array(c)], names=["key", "hash", "kind", "word", "n", "c"])


def _by_kind(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    kind, word = rows.column("kind").to_numpy(), rows.column("word").to_pylist()
    for k in np.unique(kind).tolist():
        own = np.flatnonzero(kind == k)
        yield k, own, [word[i] for i in own.tolist()]


def _expect(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    table, uses = pieces(path), np.zeros(logs.shape)
    for rows in batches:
        weight = np.minimum(rows.column("c").to_numpy(), 1.0)  # each different word once, or as far as it belongs to a class
        for k, own, words in _by_kind(rows):
            for part, lattice in lattices(words, table):
                uses[k] += lattice.expected(logs[k], weight[own[part]])
    kind, piece = np.nonzero(uses)
    yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[kind, piece])], names=["kind", "piece", "uses"])


def fit(counted: DataFrame, ends: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """By class, natural logs of the piece probabilities from the different training words (kind, word, c) and ends."""
    logs = np.repeat(pieces(path).first_logs()[None], len(ends), 0)
    trained = counted.filter("c > 0 and word <> ''").select("kind", "word", "c")
    for _ in range(rounds):
        got = trained.mapInArrow(partial(_expect, path=path, logs=logs), "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        uses = np.repeat(PRIOR * np.exp(pieces(path).first_logs())[None], len(ends), 0)
        uses[got.column("kind").to_numpy(), got.column("piece").to_numpy()] += got.column("uses").to_numpy()
        uses[:, pieces(path).end] += np.minimum(ends, 1)
        met = np.unique(got.column("kind").to_numpy())
        logs[met] = np.log(uses / uses.sum(1, keepdims=True))[met]
    return logs


class Totals:
    """By class: training words, what the discount takes of them, and ends."""

    def __init__(self, words: np.ndarray, left: np.ndarray, ends: np.ndarray):
        self.words, self.left, self.ends = words.astype(float), left.astype(float), ends.astype(float)

    def word(self, k: int, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Natural log of a word's probability from its training count and the log of its spelled probability."""
        n, d = self.words[k], self.ends[k]
        if not n:
            return spelled
        left = math.log(self.left[k] / n) + spelled
        with np.errstate(divide="ignore"):
            return math.log(n / (n + d)) + np.logaddexp(np.log(np.maximum(0, c - DISCOUNT) / n), left)

    def end(self, k: int, spelled: float) -> float:
        """Natural log of the class and of the end of a text in it."""
        own = math.log(self.ends[k] / (self.words[k] + self.ends[k])) if self.words[k] and self.ends[k] else spelled
        return own + math.log((self.ends[k] + 1) / (self.ends.sum() + len(self.ends)))


def _spell(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray, totals: Totals) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        log, c = np.zeros(rows.num_rows), rows.column("c").to_numpy()
        for k, own, words in _by_kind(rows):
            log[own] = totals.word(k, c[own], word_logs(words, pieces(path), logs[k])) / math.log(10)
        yield pa.record_batch([*(rows.column(x) for x in ("key", "n", "everywhere")), pa.array(log)], names=["key", "n", "c", "log"])


def _score(batches: Iterator[pa.RecordBatch], mixture: Mixture, often: np.ndarray, base: np.ndarray, log: np.ndarray, known: np.ndarray, end: tuple[float, int], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each text in a class a row with what its frequent words and its end add, and a row for each of its other words."""
    for rows in chunks(batches, "text"):
        raw, offsets = text_bytes(rows.column("text"))
        raw = lowered(raw)
        words = Words(raw, offsets)
        placed = Placed(words, words.hashes(raw), mixture)
        keys = placed.key
        at = np.minimum(np.searchsorted(often, keys), max(0, len(often) - 1))
        near = often[at] == keys if len(often) else np.zeros(len(keys), bool)
        part = [sums(np.where(near, x[at], 0), placed.first) if len(often) else np.zeros(len(placed.text)) for x in (base, log, known)]
        pair = rows.column("row").to_numpy()[placed.text] * CLASSES + placed.kind
        far, of = keys[~near], placed.pair[~near]
        order = np.lexsort((far, of))
        far, of = far[order], of[order]
        heads = np.flatnonzero(np.concatenate([[True], (far[1:] != far[:-1]) | (of[1:] != of[:-1])])) if len(far) else np.zeros(0, np.int64)
        many, n, k = np.diff(np.append(heads, len(far))), len(pair), len(heads)
        empty = np.zeros(k)
        key = np.concatenate([mix(pair.astype(np.uint64)), far[heads]]).view(np.int64)
        yield pa.record_batch(
            [
                pa.array(np.concatenate([pair, pair[of[heads]]])), pa.array(key), pa.array(np.concatenate([np.zeros(n, np.int64), many])),
                pa.concat_arrays([rows.column("doc_id").take(pa.array(placed.text)), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([words.count[placed.text] + 1, empty]).astype(np.int64)),
                pa.array(np.concatenate([part[2] + end[1], empty]).astype(np.int64)), pa.array(np.concatenate([part[0] + end[0], empty])), pa.array(np.concatenate([part[1] + ends[placed.kind], empty])),
            ],
            names=["pair", "key", "many", "doc_id", "n_tokens", "n_known", "base_score", "score"],
        )


def score(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (fold != HELD_OUT).alias("training"))
    mixture = fit_classes(rows)
    pairs = rows.select("text", "training").mapInArrow(partial(_count, mixture=mixture), "key long, hash long, kind int, word string, n long, c double")
    summed = pairs.groupBy("key", "hash", "kind", "word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    # a word has a row for each class at most; words of one class and length lie together, as they are worked on together
    everywhere = F.round(F.sum("c").over(Window.partitionBy("hash"))).cast("long")  # shares of a text add up to 1
    counted = saved(summed.withColumn("everywhere", everywhere).withColumn("first", F.row_number().over(Window.partitionBy("hash").orderBy("kind")) == 1).sortWithinPartitions("kind", F.length("word")), "words")
    word = F.col("word") != ""
    of_kind = counted.groupBy("kind").agg(F.sum(F.when(word, F.col("n"))).alias("all"), F.sum(F.when(word, F.col("c"))).alias("words"), F.sum(F.when(word, F.least("c", F.lit(DISCOUNT)))).alias("left"), F.sum(F.when(~word, F.col("c"))).alias("ends"), F.sum(F.when(F.col("first"), F.col("everywhere"))).alias("tokens"), F.count_if(F.col("first") & (F.col("everywhere") > 0)).alias("different"))
    got = {r["kind"]: r for r in of_kind.collect()}  # one row for each class
    size = len(mixture.prior)
    column = lambda name: np.array([(got[k][name] or 0) if k in got else 0 for k in range(size)])
    totals = Totals(column("words"), column("left"), column("ends"))
    n_all, tokens, different = int(column("all").sum()), int(column("tokens").sum()), int(column("different").sum())
    logs = fit(counted, totals.ends, path)
    spelled = saved(counted.filter(word).select("key", "kind", "word", "n", "c", "everywhere").mapInArrow(partial(_spell, path=path, logs=logs, totals=totals), "key long, n long, c long, log double"), "spelled")
    term = F.log10((F.col("c") + 1.0) / F.lit(float(tokens + different + 1)))
    top = spelled.filter(F.col("n") * FREQUENT >= n_all).select("key", "c", "log", term.alias("base")).toArrow()
    often = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(often)
    trained = round(totals.ends.sum())
    end = (math.log10((trained + 1) / (tokens + different + 1)), int(trained > 0))
    ends = np.array([totals.end(k, float(logs[k, pieces(path).end])) for k in range(size)]) / math.log(10)
    near = partial(_score, mixture=mixture, often=often[order], base=top.column("base").to_numpy()[order], log=top.column("log").to_numpy()[order], known=(top.column("c").to_numpy()[order] > 0).astype(np.int64), end=end, ends=ends)
    parts = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(near, "pair long, key long, many long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    rare = spelled.filter(F.col("n") * FREQUENT < n_all).select("key", (F.col("c") > 0).cast("long").alias("known"), term.alias("base"), "log")
    met = parts.join(rare, "key", "left")
    added = met.groupBy("pair").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.col("many") * F.coalesce("known", F.lit(0))).alias("n_known"),
        F.sum(F.col("base_score") + F.col("many") * F.coalesce("base", F.lit(0.0))).alias("base_score"),
        F.sum(F.col("score") + F.col("many") * F.coalesce("log", F.lit(0.0))).alias("score"),
    )
    # one score for each class of a text; they add up in log space
    of_text = added.groupBy(F.floor(F.col("pair") / CLASSES).alias("text")).agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base_score").alias("base_score"), F.sort_array(F.collect_list("score")).alias("scores"))
    top_score = F.element_at("scores", -1)
    total = top_score + F.log10(F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top_score)))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return of_text.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", total.alias("score"))


def op6_lattice_lm(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(source_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
