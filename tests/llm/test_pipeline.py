"""The pipeline, stage by stage, on a small corpus."""

import pytest

import corpus_pipeline
from modalgraph.llm import registry

from .test_near_dups import components
from .test_quality import corpus, counted

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in corpus(200)]
    rows += [(1000 + i, rows[i * 3 + 1][1], "en", "s", 1) for i in range(20)] + [(2000, None, None, None, None), (2001, "short", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(not bad), 0) for i, *_, bad in corpus(200) if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bad = {i for i, *_, b in corpus(200) if b}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns
        path = f"{folder}/{name}"
        new.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    kept = {r["doc_id"] for r in docs.collect()}
    assert not kept & {2000, 2001}
    assert not {i for i in kept if i >= 1000}
    clean = set(range(200)) - bad
    assert len(clean - kept) <= 3 and len(kept & bad) <= 2


def test_run_packs_what_the_stages_keep(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(rows[0].asDict())
    total = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 2048
    assert len(total) <= sum(total.values()) // 2048 + 2


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_and_on_no_rows(spark, odd, nothing, tmp_path, empty):
    where = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    (nothing if empty else odd).write.parquet(f"{where}/documents.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, where)
        if name != "best_fit_packing":
            assert new.columns == docs.columns
        new.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    rows = docs.collect()
    assert not (rows and empty)
    room = {}
    for r in rows:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 for n in room.values())


def test_stages_agree_with_plain_loops(spark, folder):
    """Rules and near-dedup by brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, folder).collect()
    table = spark.createDataFrame(kept, docs.schema)
    ruled = corpus_pipeline.STAGES[1][1](spark, table, folder).collect()
    fails = lambda t: (c := counted(t))[0] < 50 or 100 * c[4] > 50 * c[0]
    assert {r["doc_id"] for r in ruled} <= {r["doc_id"] for r in kept if not fails(r["text"])}
    left = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(ruled, docs.schema), folder).collect()
    found = components([(r["doc_id"], r["text"]) for r in ruled])
    assert {r["doc_id"] for r in left} == set(found.values())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
