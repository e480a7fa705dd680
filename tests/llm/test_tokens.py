"""Token files, packing and byte-level BPE against the libraries they stand for."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from modalgraph.llm import byte_bpe, packing, token_files
from modalgraph.llm.common import text_bytes, work_path
from modalgraph.llm.tokens import CachedTokenizer

public = pytest.importorskip("public_tokenizers")
JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.text(alphabet=st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0 '’stmdrevlabAB1²½é,.!_日本ßΩ😀"), max_size=60)


@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8))
@settings(max_examples=150, deadline=None)
def test_cached_ids_are_the_librarys(texts):
    cached = _cached()
    for text, ids in zip(texts, cached.encode(texts), strict=True):
        assert ids.tolist() == (cached.library.encode(text, add_special_tokens=False).ids if text else [])


def _cached(kept=[]):  # noqa: B006
    if not kept:
        kept.append(CachedTokenizer(JSON))
    return kept[0]


def test_the_cache_starts_anew(monkeypatch):
    cached = CachedTokenizer(JSON)
    first = [x.tolist() for x in cached.encode(["some text here", "and more"])]
    monkeypatch.setattr("modalgraph.llm.tokens.KEEP", 1)
    assert [x.tolist() for x in cached.encode(["some text here", "and more"])] == first


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd, odd_rows, library):
    folder = work_path(spark, "test-files")
    index = token_files.write(odd, folder, JSON)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in token_files.read(index, folder).collect())
    want = sorted(((d if d is not None else -1, len(i), crc(i)) for d, t, *_ in odd_rows for i in [library(t)]), key=lambda x: x[0])
    assert [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got)])[:-1].tolist()
    assert sorted((g[3] if g[3] is not None else -1, g[1], g[2]) for g in got) == sorted(want)
    ids = [g[3] if g[3] is not None else -1 for g in got]
    assert ids == sorted(ids)


def test_sequences_of_a_file_are_views_with_masks(tmp_path):
    path = str(tmp_path / "x.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.Writer(sink, width=8)
        places = [w.append(np.arange(n, dtype=np.uint32)) for n in (5, 900, 0, 3)]
        w.close()
    r = token_files.Reader(fs.LocalFileSystem(), path)
    assert places == [0, 5, 905, 905]
    assert np.concatenate(list(r.slices(5, 900))).tolist() == list(range(900))
    ids, mask = r.sequence(113)
    assert ids.tolist()[:4] == [899, 0, 1, 2] and mask.tolist() == [True] * 4 + [False] * 4
    assert not ids.flags.owndata
    assert r.file.schema.field("ids").type == pa.list_(pa.uint16(), 8)


def test_no_rows(spark, nothing):
    folder = work_path(spark, "test-files")
    assert token_files.read(token_files.write(nothing, folder, JSON), folder).collect() == []
    assert packing.pack(nothing, JSON).collect() == []
    assert byte_bpe.digests(nothing, RANKS).collect() == []


def test_packing_covers_every_token_once(odd, odd_rows, library):
    got = packing.pack(odd, JSON).collect()
    assert sum(r["length"] for r in got) == sum(len(library(t)) for _, t, *_ in odd_rows)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 23)
    ids = library(odd_rows[23][1])
    assert [(p, s, n) for p, s, n, _ in long] == [(i, s, n) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    assert all(c == crc(ids[s : s + n]) for _, s, n, c in long)


def test_cuts():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_plans_use_each_length_as_often_as_it_occurs(histogram):
    plan = packing.plan(histogram, 64)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    bins = sum(t for _, t in plan)
    only = sum(t for _, t in packing.best_fit(dict(histogram), 64))
    assert bins <= only


def test_plans_are_near_the_least():
    rng = random.Random(1)
    histogram = {}
    for _ in range(20_000):
        n = min(2047, max(1, int(rng.lognormvariate(6, 1))))
        histogram[n] = histogram.get(n, 0) + 1
    least = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert sum(t for _, t in packing.plan(histogram)) <= 1.001 * least + 1


@given(st.lists(st.one_of(st.none(), TEXTS), max_size=8))
@settings(max_examples=200, deadline=None)
def test_bpe_is_the_librarys(ranked, texts):
    codec = byte_bpe.codec(RANKS)
    e = codec.encode(*text_bytes(pa.array(texts, pa.string())))
    raw, at = codec.decode(e.ids, e.first)
    for i, t in enumerate(texts):
        assert e.of(i).tolist() == ranked.encode_ordinary(t or "")
        assert raw[at[i] : at[i + 1]].tobytes() == (t or "").encode()


def test_bpe_of_every_code_point(ranked):
    codec = byte_bpe.codec(RANKS)
    texts = [f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c % 37 == 5 or c < 0x3100]
    e = codec.encode(*text_bytes(pa.array(texts)))
    assert [t for i, t in enumerate(texts) if e.of(i).tolist() != ranked.encode_ordinary(t)] == []


def test_long_slices_are_merged_alike():
    ranks = byte_bpe.codec(RANKS).ranks
    rng = random.Random(2)
    for n in (2, 30, 64):
        piece = bytes(rng.choice(b"abcdefgh") for _ in range(n))
        if piece not in ranks:
            assert byte_bpe.merged(piece, ranks) == byte_bpe._merged_by_heap(piece, ranks)


def test_bpe_digests_offsets_and_decoding(odd, odd_rows, ranked):
    got = sorted(tuple(str(x) for x in r) for r in byte_bpe.digests(odd, RANKS).collect())
    want = []
    for d, t, *_ in odd_rows:
        ids = ranked.encode_ordinary(t or "")
        want.append((str(d), str(len(ids)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = byte_bpe.encode(odd, RANKS)
    assert sorted((str(r["doc_id"]), r["text"]) for r in byte_bpe.decode(encoded, RANKS).collect()) == sorted((str(d), t or "") for d, t, *_ in odd_rows)
    row = encoded.filter("doc_id = 28").head()
    tokens = [ranked.decode_single_token_bytes(i) for i in row["ids"]]
    assert row["offsets"] == np.cumsum([0, *map(len, tokens)])[:-1].tolist()


def test_ids_that_do_not_fit_are_an_error(tmp_path):
    with pytest.raises(ValueError, match="wide"):
        token_files.Writer(str(tmp_path / "x.arrow")).append(np.array([1, 65_536]))
    assert token_files.Writer(str(tmp_path / "y.arrow"), wide=True).append(np.array([1, 65_536])) == 0


def test_parts_of_a_shuffle_follow_the_table(spark, tmp_path):
    from modalgraph.llm import common

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(spark.createDataFrame([(1, "a")], "a int, b string")) == least
    spark.range(200_000).write.parquet(f"file://{tmp_path}/t")
    table, before = spark.read.parquet(f"file://{tmp_path}/t"), common.PART_BYTES
    try:
        common.PART_BYTES = 10_000
        assert common.partitions(table) > least
    finally:
        common.PART_BYTES = before
