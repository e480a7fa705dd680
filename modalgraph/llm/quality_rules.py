"""Quality rules: a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus, beside plain counts.

Runs of ``WIDTH`` bytes are hashed to ``2 ** BITS`` buckets.  Every text of the corpus adds to the raw multinomial; texts whose
ids are labelled good and not toxic add to the target multinomial too.
A text's score is the mean over its runs of log(target / raw), the target smoothed towards the raw counts; texts below
``THRESHOLD`` are rejected.  Each task sends one count for each bucket it met, so what is gathered is bounded by the buckets.

Trusted ids meet the texts in a join, broadcast after a count of them (``BROADCAST_IDS`` at most) and else by shuffle.

Defined results: a null or empty text has no words, fails the base rules and scores 0; a corpus with no trusted text scores 0
everywhere and only the base rules reject; repeated rows are judged alike; an empty table gives no rows; other columns are
ignored by ``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, chunks, source_table, sums, text_bytes
from .text_stats import TextStats, grams

WIDTH, BITS, SMOOTHING, THRESHOLD = 4, 16, 65_536.0, -0.35
MIN_WORDS, REPEAT_PERCENT = 50, 50
VERDICT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(1 << BITS, np.int64)
    target = np.zeros(1 << BITS, np.int64)
    for rows in chunks(batches, "text"):
        data, offsets = text_bytes(rows.column("text"))
        bucket, first = grams(data, offsets, WIDTH, BITS)
        raw += np.bincount(bucket, minlength=1 << BITS)
        own = rows.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        target += np.bincount(bucket[np.repeat(own, np.diff(first))], minlength=1 << BITS)
    met = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(met, pa.int32()), pa.array(raw[met]), pa.array(target[met])], names=["bucket", "raw", "target"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): the ids of rows labelled good and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()
    return labels.filter(good).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket, from all texts; ``trusted`` has different ids (doc_id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = trusted.select("doc_id", F.lit(True).alias("trusted"))
    known = F.broadcast(known) if trusted.count() <= BROADCAST_IDS else known
    flagged = rows.join(known, "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = flagged.mapInArrow(_count, "bucket int, raw long, target long")
    got = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    ratio = np.zeros(1 << BITS)
    if target.sum():
        seen, share = raw > 0, raw / raw.sum()
        smooth = (target + SMOOTHING * share) / (target.sum() + SMOOTHING)
        ratio[seen] = np.log(smooth[seen] / share[seen])
    return ratio


def verdicts(column: pa.Array, ratio: np.ndarray) -> dict[str, np.ndarray]:
    stats = TextStats(column)
    bucket, first = grams(stats.raw, stats.offsets, WIDTH, BITS)
    llr = sums(ratio[bucket], first) / np.maximum(1, np.diff(first))
    failed = (stats.n_words < MIN_WORDS) | (100 * stats.n_repeat_words > REPEAT_PERCENT * stats.n_words)
    return {"n_words": stats.n_words, "word_chars": stats.word_chars, "n_symbols": stats.n_symbols, "n_dup_lines": stats.n_dup_lines, "n_repeat_words": stats.n_repeat_words, "base_failed": failed, "llr": llr, "kept": ~failed & (llr >= THRESHOLD)}


def _judge(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, "text"):
        found = verdicts(rows.column("text"), ratio)
        yield pa.record_batch([rows.column("doc_id"), *(pa.array(v) for v in found.values())], names=["doc_id", *found])


def _keep(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, text: str) -> Iterator[pa.RecordBatch]:
    for rows in chunks(batches, text):
        yield rows.filter(pa.array(verdicts(rows.column(text), ratio)["kept"]))


def judge(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with its counts, score and verdict."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_judge, ratio=ratio), VERDICT)


def keep(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of documents that pass, with all their columns."""
    return docs.mapInArrow(partial(_keep, ratio=ratio, text=text_col), docs.schema)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))))
