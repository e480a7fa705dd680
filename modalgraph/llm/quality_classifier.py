"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad or abstains on a whole text.  Only the counts of vote patterns over all documents are gathered
(three votes for each labeller bound their number); expectation-maximisation over them estimates how each labeller votes for
good and for bad texts.  The posterior of each pattern then labels a bounded sample of documents (``SAMPLE`` at most, chosen by
hash), on which a logistic scorer is trained in one task; it judges every document.  Its only features are the shares of hashed
byte runs, a run in words that the text repeats being another than the same run elsewhere; what the labellers measure is not
among them.  No gold label is used.

Defined results: texts without words, null texts included, score 0 and are rejected; equal texts get equal scores; an empty
table gives no rows and a model that keeps everything; other columns are ignored by ``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, saved, source_table, sums
from .text_stats import TextStats, grams

WIDTH, BITS, SAMPLE = 3, 12, 4_000
BAD, GOOD, ABSTAIN = 0, 1, 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True
_PIPE = np.zeros(256, bool)
_PIPE[124] = True


def _vote(value: np.ndarray, bad_over: float, good_under: float) -> np.ndarray:
    return np.select([value > bad_over, value <= good_under], [BAD, GOOD], ABSTAIN)


def measures(stats: TextStats) -> dict[str, np.ndarray]:
    words, chars, lines = np.maximum(1, stats.n_words), np.maximum(1, stats.word_chars), np.maximum(1, stats.n_lines)
    return {
        "symbols": stats.n_symbols / chars,
        "symbol_words": stats.n_symbols / words,
        "upper": stats.bytes_in(_UPPER) / np.maximum(1, stats.bytes_in(_LETTER)),
        "bangs": stats.bytes_in(_BANG) / words,
        "pipes": stats.bytes_in(_PIPE) / words,
        "repeats": stats.n_repeat_words / words,
        "copied_lines": stats.n_dup_lines / lines,
        "length": chars / words / 20,
        "open_lines": 1 - stats.n_closed_lines / lines,
    }


def votes(stats: TextStats) -> np.ndarray:
    """A row for each text with the votes of all labellers, which overlap in what they look at."""
    m = measures(stats)
    found = [
        _vote(m["symbols"], 0.03, 0.0),
        _vote(m["symbol_words"], 0.25, 0.01),
        _vote(m["upper"], 0.25, 0.08),
        _vote(m["bangs"], 0.2, 0.02),
        _vote(m["pipes"], 0.1, 0.0),
        _vote(m["repeats"], 0.6, 0.4),
        _vote(m["copied_lines"], 0.6, 0.5),
        np.select([(m["length"] < 0.1) | (m["length"] > 0.7), (m["length"] > 0.15) & (m["length"] < 0.45)], [BAD, GOOD], ABSTAIN),
        np.select([(m["open_lines"] > 0.9) & (stats.n_words > 20), m["open_lines"] < 0.4], [BAD, GOOD], ABSTAIN),
    ]
    return np.stack(found, 1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, prior of the classes, vote probabilities[labeller, class, vote]).

    Bad texts are bad in different ways, which one class with independent votes cannot tell: there is one good class and one
    bad class for each labeller, a pattern being first suspected of what its votes for bad say.
    """
    bad = (patterns == BAD).astype(float)
    good = np.where(bad.sum(1) == 0, 0.97, np.where(bad.sum(1) == 1, 0.3, 0.05))
    kinds = np.where(bad.sum(1, keepdims=True) > 0, bad / np.maximum(1, bad.sum(1, keepdims=True)), 1 / bad.shape[1])
    post = np.concatenate([good[:, None], (1 - good)[:, None] * kinds], 1)
    for _ in range(rounds):
        weight = post * counts[:, None]
        prior = (weight.sum(0) + 0.1) / (weight.sum() + 0.1 * post.shape[1])
        probability = np.stack([np.stack([weight[patterns[:, j] == v].sum(0) for v in range(3)], 1) for j in range(patterns.shape[1])]) + 0.1
        probability /= probability.sum(2)[:, :, None]
        log = np.log(prior) + sum(np.log(probability[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post[:, 0], prior, probability


def runs(stats: TextStats) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte run and the place of each text's first (n + 1)."""
    return grams(stats.raw, stats.offsets, WIDTH, BITS, stats.repeated_bytes())


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of good for each text."""
        stats = TextStats(column, lines=False)
        bucket, first = runs(stats)
        margin = self.bias + sums(self.weights[bucket], first) / np.maximum(1, np.diff(first))
        return np.where(stats.n_words > 0, 1 / (1 + np.exp(-np.clip(margin, -500, 500))), 0.0)


def train(features: np.ndarray, labels: np.ndarray, steps: int = 250, ridge: float = 3e-3) -> Model:
    """Logistic regression on soft labels; features are scaled for the descent and the scale is folded into the weights."""
    if not len(labels):
        return Model(np.zeros(1 << BITS), 30.0)
    x = features  # scaled in place: the sample is the most that is held
    mean = x.mean(0, dtype=np.float64).astype(np.float32)
    x -= mean
    scale = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + np.float32(1e-4)
    x /= scale
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        grad = np.append(x.T @ error + ridge * w, error.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        step = 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    weights = w / scale
    return Model(weights.astype(np.float64), b - float(weights @ mean))


def packed(row: np.ndarray) -> bytes:
    """The features that are not 0 and their places, as most are 0."""
    at = np.flatnonzero(row)
    return row[at].astype("<f4").tobytes() + at.astype("<u2").tobytes()


def unpack(data: bytes, row: np.ndarray) -> None:
    """Fills a row of zeros with what ``packed`` kept."""
    n = len(data) // 6
    row[np.frombuffer(data, "<u2", offset=4 * n)] = np.frombuffer(data, "<f4", n)


def _survey(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    """The vote pattern of each text and, of those in the sample, its feature shares."""
    for rows in chunks(batches, "text"):
        stats = TextStats(rows.column("text"))
        pattern = ["".join(map(str, v)) for v in votes(stats).tolist()]
        chosen = (rows.column("key").to_numpy() <= cut) & (stats.n_words > 0)
        bucket, first = runs(stats)
        shares = [None] * len(pattern)
        for i in np.flatnonzero(chosen).tolist():
            shares[i] = packed(np.bincount(bucket[first[i] : first[i + 1]], minlength=1 << BITS).astype("<f4") / max(1, first[i + 1] - first[i]))
        yield pa.record_batch([rows.column("key"), pa.array(pattern), pa.array(stats.n_words > 0), pa.array(shares, pa.binary())], names=["key", "pattern", "worded", "features"])


def _train(batches: Iterator[pa.RecordBatch], belief: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """One row: the model trained on all rows of the task."""
    rows = pa.Table.from_batches(batches, pa.schema([("pattern", pa.string()), ("features", pa.binary())]))
    features = np.zeros((rows.num_rows, 1 << BITS), np.float32)
    for row, data in zip(features, rows.column("features"), strict=True):
        unpack(data.as_py(), row)
    model = train(features, np.array([belief[p] for p in rows.column("pattern").to_pylist()]))
    yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).cast("string").alias("text"))
    keys = rows.select("key").orderBy("key").limit(sample).agg(F.max("key")).head()[0]
    surveyed = saved(rows.mapInArrow(partial(_survey, cut=-(1 << 63) if keys is None else keys), "key long, pattern string, worded boolean, features binary"), "votes")
    counted = surveyed.filter("worded").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    if not counted:
        return train(np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    patterns = np.array([[int(v) for v in r["pattern"]] for r in counted])
    post, _, _ = expectation_maximisation(patterns, np.array([r["n"] for r in counted], float))
    belief = {r["pattern"]: p for r, p in zip(counted, post.tolist(), strict=True)}
    chosen = surveyed.filter("features is not null").orderBy("key", F.xxhash64("features"), "features").limit(sample).select("pattern", "features")
    got = chosen.coalesce(1).mapInArrow(partial(_train, belief=belief), "weights binary, bias double").head()
    return Model(np.frombuffer(got["weights"]), got["bias"])


def _judge(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, "text"):
        score = model.scores(rows.column("text"))
        yield pa.record_batch([rows.column("doc_id"), pa.array(score), pa.array(score >= 0.5)], names=["doc_id", "score", "kept"])


def _keep(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, text):
        yield rows.filter(pa.array(model.scores(rows.column(text)) >= 0.5))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability of good), kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_judge, model=model), "doc_id long, score double, kept boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of good documents, with all their columns."""
    return docs.mapInArrow(partial(_keep, model=model, text=text_col), docs.schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs))
