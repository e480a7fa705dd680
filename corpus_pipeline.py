"""Documents to packed training sequences, in stages; each stage's output is written and is the next one's input.

Defined results of all stages: a null text is an empty one, which the classifier rejects; rows of null or repeated ids are rows
like others, of which the near-dedup leaves one for each class; an empty table gives no rows; other columns pass through the
filtering stages as they are and are ignored by the packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from modalgraph.llm import near_dups, packing, quality_classifier, quality_rules
from modalgraph.llm.common import saved, source_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to these, rejects go; so do texts without words."""
    return quality_classifier.keep(docs, quality_classifier.fit(docs))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or the likelihood ratio go; trusted ids are those of the labels beside the input."""
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, quality_rules.fit(docs, trusted))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one of the least id; null ids come last."""
    return near_dups.keep(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places in sequences of at most 2,048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can express neither the fitted models nor the tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
