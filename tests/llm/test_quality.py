"""Quality classifier and rules, on counts by brute force and on labelled documents."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modalgraph.llm import quality_classifier, quality_rules
from modalgraph.llm.text_stats import TextStats

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated, len(marked)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t\x85", max_size=60)), max_size=10))
@settings(max_examples=200, deadline=None)
def test_counts(texts):
    s = TextStats(pa.array(texts, pa.string()))
    got = list(zip(*(x.tolist() for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)), strict=True))
    assert got == [counted(t) for t in texts]


def trusted(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id bigint")


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_rules_on_odd_rows(spark, odd, odd_rows, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", broadcast)
    ratio = quality_rules.fit(odd, trusted(spark, 0, 1, 2, 3))
    assert ratio.any()
    got = quality_rules.judge(odd, ratio).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((str(d), *counted(t)) for d, t, *_ in odd_rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep(odd, ratio)
    assert kept.schema == odd.schema
    assert kept.count() == sum(r["kept"] for r in got)


def test_rules_score_is_the_mean_log_ratio(spark):
    texts = ["abcabcabc", "xyzxyz", "abcxyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ratio = quality_rules.fit(docs, trusted(spark, 0))
    grams = lambda t: [t[i : i + 4] for i in range(len(t) - 3)]
    raw, target = Counter(g for t in texts for g in grams(t)), Counter(grams(texts[0]))
    n, m, s = sum(raw.values()), sum(target.values()), quality_rules.SMOOTHING
    log = {g: np.log(((target[g] + s * c / n) / (m + s)) / (c / n)) for g, c in raw.items()}
    got = {r["doc_id"]: r["llr"] for r in quality_rules.judge(docs, ratio).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(np.mean([log[g] for g in grams(t)]))


def test_rules_without_trusted_texts(odd, spark):
    labels = spark.createDataFrame([(None, 1, 0), (99, 1, None), (1, 1, 1), (2, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert [r[0] for r in quality_rules.trusted_ids(labels).collect()] == [99]
    ratio = quality_rules.fit(odd, quality_rules.trusted_ids(labels))
    assert not ratio.any()
    assert {r["llr"] for r in quality_rules.judge(odd, ratio).collect()} == {0.0}


@pytest.mark.parametrize("module", [quality_rules, quality_classifier])
def test_no_rows(spark, nothing, module):
    model = quality_rules.fit(nothing, trusted(spark)) if module is quality_rules else quality_classifier.fit(nothing)
    assert module.judge(nothing, model).collect() == []
    assert module.keep(nothing, model).collect() == []


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(60, 200)).split()
        text = "\n".join(" ".join(words[j : j + 12]).capitalize() + "." for j in range(0, len(words), 12))
        bad = i % 7 == 0
        if bad:
            w = text.split()
            text = [" ".join(x + rng.choice(["***", "&&&", "###"]) for x in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w), " ".join([w[0]] * len(w))][i // 7 % 4]
        out.append((i, text, 0, "", "", "", "", 0, 0, bad))
    return out


def test_classifier_finds_junk_without_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:9] for r in rows], SCHEMA)
    model = quality_classifier.fit(docs)
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.judge(docs, model).collect()}
    wrong = [i for i, *_, bad in rows if got[i] == bad]
    assert len(wrong) <= 4
    kept = quality_classifier.keep(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_classifier_on_odd_rows(odd):
    model = quality_classifier.fit(odd)
    got = quality_classifier.judge(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r["doc_id"] in (20, 21, 22):
            assert r["score"] == 0 and not r["kept"]
    assert len({r["score"] for r in got if r["doc_id"] in (0, 24, 25)}) == 1


def test_expectation_maximisation_finds_the_good_class():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    votes = np.where(truth[:, None], 1, 0) * np.ones((1, 5), int)
    votes = np.where(rng.random(votes.shape) < 0.05, 1 - votes, votes)
    votes = np.where(rng.random(votes.shape) < 0.1, 2, votes)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, prior, _ = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert ((post[which] > 0.5) == truth).mean() > 0.97
    assert abs(prior[0] - 0.8) < 0.05


def test_classifier_tells_4096_buckets_of_runs_apart():
    rng = np.random.default_rng(1)
    stats = TextStats(pa.array(["".join(chr(c) for c in rng.integers(97, 123, 60_000))]))
    bucket, _ = quality_classifier.grams(stats.raw, stats.offsets, quality_classifier.WIDTH, quality_classifier.BITS)
    assert 1 << 11 < len(np.unique(bucket)) and bucket.max() < 1 << 12


def test_features_are_packed_without_loss():
    row = np.zeros(1 << quality_classifier.BITS, np.float32)
    row[[0, 7, 2048, 4095]] = [1 / 3, 1e-7, 0.25, 1]
    for x in (row, np.zeros_like(row), np.ones_like(row)):
        got = np.zeros_like(x)
        quality_classifier.unpack(quality_classifier.packed(x), got)
        assert (got == x).all()


def plain_votes(text):
    """The labellers by plain loops over one text."""
    text = text or ""
    n_words, chars, symbols, copied, repeats = counted(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    words, letters = max(1, n_words), [c for c in text if c.isascii() and c.isalpha()]
    level = lambda x, bad, good: 0 if x > bad else 1 if x <= good else 2
    opened = 1 - sum(x[-1] in ".!?:;\"" for x in lines) / max(1, len(lines))
    size = chars / words / 20
    return [
        level(symbols / max(1, chars), 0.03, 0.0), level(symbols / words, 0.25, 0.01), level(sum(c.isupper() for c in letters) / max(1, len(letters)), 0.25, 0.08),
        level(text.count("!") / words, 0.2, 0.02), level(text.count("|") / words, 0.1, 0.0), level(repeats / words, 0.6, 0.4), level(copied / max(1, len(lines)), 0.6, 0.5),
        0 if size < 0.1 or size > 0.7 else 1 if 0.15 < size < 0.45 else 2, 0 if opened > 0.9 and n_words > 20 else 1 if opened < 0.4 else 2,
    ]


def plain_buckets(text):
    """The hashed runs of a text by plain loops: a run that begins in a word of a repeated window is marked."""
    data, words = (text or "").encode(), list(re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    windows = Counter(tuple(w.group() for w in words[i : i + 3]) for i in range(len(words) - 2))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(w.group() for w in words[i : i + 3])] > 1:
            marked |= {b for w in words[i : i + 3] for b in range(w.start(), w.end())}
    out = []
    for i in range(len(data) - quality_classifier.WIDTH + 1):
        key = int(i in marked)
        for b in data[i : i + quality_classifier.WIDTH]:
            key = (key * 0x01000193 + b) % 2**32
        key = (key ^ key >> 15) * 0x2C1B3C6D % 2**32
        out.append(key >> 32 - quality_classifier.BITS)
    return out


def test_votes_and_scores_are_those_of_plain_loops(spark):
    rows = corpus(60) + [(100, None, *[None] * 8), (101, "a b c a b c a b c é!", *[None] * 8), (102, "x", *[None] * 8)]
    texts = [r[1] for r in rows]
    assert quality_classifier.votes(TextStats(pa.array(texts, pa.string()))).tolist() == [plain_votes(t) for t in texts]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string")
    model = quality_classifier.fit(docs)
    # the model anew, from plain counts of all texts: fewer than the sample, so all are trained on
    worded = [t for t in texts if t and WORD.search(t)]
    patterns = Counter("".join(map(str, plain_votes(t))) for t in worded)
    names = sorted(patterns)
    post, _, _ = quality_classifier.expectation_maximisation(np.array([[int(v) for v in p] for p in names]), np.array([patterns[p] for p in names], float))
    belief = dict(zip(names, post, strict=True))
    shares = np.array([np.bincount(plain_buckets(t), minlength=1 << quality_classifier.BITS) / max(1, len(plain_buckets(t))) for t in worded], np.float32)
    again = quality_classifier.train(shares, np.array([belief["".join(map(str, plain_votes(t)))] for t in worded]))
    for r in quality_classifier.judge(docs, model).collect():
        text = texts[[x[0] for x in rows].index(r["doc_id"])]
        own = plain_buckets(text)
        margin = again.bias + sum(again.weights[b] for b in own) / max(1, len(own))
        want = 1 / (1 + np.exp(-margin)) if text and WORD.search(text) else 0.0
        assert r["score"] == pytest.approx(want, abs=2e-3)


def test_hashed_runs_alone_carry_the_verdict(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:9] for r in rows], SCHEMA)
    model = quality_classifier.fit(docs)
    assert model.weights.shape == (1 << quality_classifier.BITS,)
    flat = quality_classifier.Model(np.zeros_like(model.weights), model.bias)
    assert len({r["kept"] for r in quality_classifier.judge(docs, flat).collect()}) == 1
    assert len({r["kept"] for r in quality_classifier.judge(docs, model).collect()}) == 2


def test_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 3, t) for i, t, *_ in corpus(90)], "doc_id bigint, text string")
    model = quality_classifier.fit(docs, sample=20)
    assert np.isfinite(model.weights).all()
