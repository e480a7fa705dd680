"""Lattice scoring against enumeration of all segmentations, and the base score by brute force."""

import math
import re
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pytest

from modalgraph.llm import lattice_lm

public = pytest.importorskip("public_tokenizers")
PATH = public.path("piece_bpe_32k.model")


def spellings(word, table, logs):
    """All ways to spell a word, by recursion."""
    known = {p: i for i, p in enumerate(table.text)}
    byte = logs[table.byte] - math.log(256)

    def rest(s):
        if not s:
            return 1.0
        total = sum(math.exp(logs[known[s[:k]]]) * rest(s[k:]) for k in range(1, min(len(s), table.longest) + 1) if s[:k] in known)
        return total if s[0] in known else total + math.exp(byte * len(s[0].encode())) * rest(s[1:])

    return math.log(rest(lattice_lm.START + word))


@pytest.mark.parametrize("word", ["a", "the", "therein", "überhaupt", "naïve,", "日本", "x\u0007y", "😀😀"])
def test_forward_adds_up_all_segmentations(word):
    table = lattice_lm.pieces(PATH)
    logs = table.first_logs()
    assert lattice_lm.word_logs([word], table, logs)[0] == pytest.approx(spellings(word, table, logs), abs=1e-9)


def test_words_of_all_lengths_keep_their_places():
    table = lattice_lm.pieces(PATH)
    logs = table.first_logs()
    words = ["bb", "a", "ccc", "dd", "e", "longerword" * 30]
    assert lattice_lm.word_logs(words, table, logs) == pytest.approx([lattice_lm.word_logs([w], table, logs)[0] for w in words])


def test_probabilities_of_pieces_sum_to_one():
    assert np.exp(lattice_lm.pieces(PATH).first_logs()).sum() == pytest.approx(1)


def test_expected_uses_spell_every_word():
    table = lattice_lm.pieces(PATH)
    logs = table.first_logs()
    words = ["therein", "naïve", "😀"]
    uses = sum(lattice.expected(logs, np.array([2.0] * len(own))) for own, lattice in lattice_lm.lattices(words, table))
    spelled = sum(u * len(p.encode()) for u, p in zip(uses, table.text, strict=False)) + uses[table.byte]
    for _, lattice in lattice_lm.lattices([*words, "y" * 400], table):
        weight = np.arange(1.0, lattice.n + 1)
        assert np.allclose(lattice.expected(logs, weight), lattice.expected_by_logs(logs, weight))
    assert spelled == pytest.approx(2 * sum(len((lattice_lm.START + w).encode()) for w in words))


def test_training_raises_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "PRIOR", 1e-3)
    table = lattice_lm.pieces(PATH)
    counted = spark.createDataFrame([(0, "therein", 5.0), (0, "there", 9.0), (0, "in", 20.0), (0, "unseen", 0.0), (0, "", 3.0), (1, "other", 0.0)], "kind int, word string, c double")
    score = lambda logs: sum(c * x for c, x in zip((1, 1, 1), lattice_lm.word_logs(["therein", "there", "in"], table, logs), strict=True)) + logs[table.end]
    fitted = [lattice_lm.fit(counted, np.array([3, 0]), PATH, rounds) for rounds in (0, 1, 2, 4)]
    runs = [score(logs[0]) for logs in fitted]
    assert runs[0] < runs[1] < runs[2] <= runs[3] + 1e-9
    for logs in fitted:
        assert np.exp(logs[0]).sum() == pytest.approx(1)
        assert (logs[1] == table.first_logs()).all()


def bags_of(counts):
    doc, at = np.nonzero(counts)
    return lattice_lm.Bags(at, counts[doc, at], np.searchsorted(doc, np.arange(len(counts) + 1)))


def test_classes_tell_languages_apart():
    rng = np.random.default_rng(1)
    share = rng.dirichlet(np.full(lattice_lm.BUCKETS, 0.01), 3)
    kind = rng.integers(0, 3, 200)
    counts = np.stack([rng.multinomial(120, share[k]) for k in kind]).astype(np.float32)
    assert (bags_of(counts).dense() == counts).all()
    mixture = lattice_lm.Mixture(bags_of(counts), k=3)
    bucket = [np.repeat(np.arange(lattice_lm.BUCKETS), row.astype(int)).astype(np.uint64) for row in counts]
    got = mixture.shares(np.concatenate(bucket), np.concatenate([[0], np.cumsum([len(b) for b in bucket])]))
    assert np.allclose(got.sum(0), 1) and ((got == 0) | (got >= lattice_lm.LEAST)).all()
    assert len({(g, k) for g, k in zip(got.argmax(0).tolist(), kind.tolist(), strict=True)}) == 3
    assert lattice_lm.Mixture(bags_of(counts[:0])).shares(np.zeros(0, np.uint64), np.zeros(3, np.int64)).tolist() == [[1, 1]]


def test_expected_counts_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.01, (7, lattice_lm.BUCKETS)).astype(float)
    logs, prior = np.log(rng.dirichlet(np.ones(lattice_lm.BUCKETS), 3)), np.log([0.5, 0.3, 0.2])
    got = bags_of(counts).expected(logs, prior)
    joint = np.exp(counts @ logs.T + prior)
    post = joint / joint.sum(1, keepdims=True)
    assert np.allclose(got[:, 0], post.sum(0)) and np.allclose(got[:, 1:-1], post.T @ counts) and got[0, -1] == pytest.approx(np.log(joint.sum(1)).sum())
    bags = bags_of(counts)
    batch = lattice_lm.pa.record_batch([lattice_lm.pa.array([bags.packed(0, 3), bags.packed(3, 7)])], names=["bags"])
    assert (lattice_lm.Bags.of([bags.packed(0, 3), bags.packed(3, 7)]).dense() == counts).all()
    again = np.frombuffer(next(lattice_lm._expect_classes(iter([batch]), logs, prior)).column("sums")[0].as_py()).reshape(3, -1)
    assert np.allclose(got, again)


def test_word_probabilities_stay_within_one():
    counts = np.array([10, 5, 3, 2])
    totals = lattice_lm.Totals(np.array([20, 0]), np.array([np.minimum(counts, lattice_lm.DISCOUNT).sum(), 0]), np.array([5, 0]))
    spelled = np.log([0.2, 0.1, 0.05, 0.05])
    seen = np.exp(totals.word(0, counts, spelled)).sum()
    unseen = np.exp(totals.word(0, np.zeros(1), np.log([0.6])))[0]
    assert seen + unseen + 5 / 25 == pytest.approx(1)
    assert totals.word(1, np.zeros(4), spelled) == pytest.approx(spelled)


@pytest.mark.parametrize("frequent", [1, 20_000])
def test_scores_and_counts(spark, odd, odd_rows, monkeypatch, frequent):
    """Whether words are scored beside the text or in the join must not matter."""
    monkeypatch.setattr(lattice_lm, "FREQUENT", frequent)
    got = lattice_lm.score(odd, PATH).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(x for d, t, *_ in odd_rows if not held(d) for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for d, t, *_ in odd_rows:
        own = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own)
        rows.append((str(d), held(d), len(own), sum(counts[x] > 0 for x in own), n, round(base, 5)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r["score"])
    assert by_id[20] == by_id[21] and by_id[0][0] == pytest.approx(by_id[24][0])
    assert all(s < 0 for x in by_id.values() for s in x)


def test_a_text_scores_the_sum_of_its_words(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "fit_classes", lambda rows: lattice_lm.Mixture(bags_of(np.zeros((0, lattice_lm.BUCKETS)))))
    texts = {1: "The cat sat", 3: "cat cat Zebra", 4: "zebra", 5: "unheardof"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    table = lattice_lm.pieces(PATH)
    trained = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    words = Counter(w for d in trained for w in texts[d].lower().split())
    n, v, d = sum(words.values()), len(words), len(trained)
    logs = lattice_lm.fit(spark.createDataFrame([(0, w, float(c)) for w, c in sorted(words.items())], "kind int, word string, c double"), np.array([d]), PATH)[0]
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score(docs, PATH).collect()}
    for i, text in texts.items():
        total = math.log(d / (n + d))
        for w in text.lower().split():
            spelled = math.exp(lattice_lm.word_logs([w], table, logs)[0])
            total += math.log(n / (n + d) * (max(0, words[w] - 0.75) / n + 0.75 * v / n * spelled))
        assert got[i] == pytest.approx(total / math.log(10))


def test_no_rows(nothing):
    assert lattice_lm.score(nothing, PATH).collect() == []


def test_classes_are_fitted_to_all_training_texts(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'abc'[i % 3]}{w}" for w in rng.integers(0, 40, 30)) for i in range(150)]
    rows = spark.createDataFrame([(i, t, i % 7 != 2) for i, t in enumerate(texts)], "doc_id bigint, text string, training boolean").repartition(5)
    bags = rows.filter("training").selectExpr("xxhash64(doc_id) AS key", "text").mapInArrow(partial(lattice_lm._bags, cut=(1 << 63) - 1), "key bigint, bags binary").collect()
    counts = lattice_lm.Bags.of([r["bags"] for r in sorted((r for r in bags if r["key"] is not None), key=lambda r: r["key"])]).dense()
    assert lattice_lm.Bags.of([r["bags"] for r in bags if r["key"] is None]).dense().sum() == counts.sum()
    assert counts.sum() == 30 * sum(i % 7 != 2 for i in range(150))
    got = lattice_lm.fit_classes(rows, sample=20)
    want = lattice_lm.Mixture(bags_of(counts[:20]), expect=bags_of(counts).expected)
    assert np.allclose(got.logs, want.logs, atol=1e-3) and np.allclose(got.prior, want.prior, atol=1e-3)
    assert not np.allclose(got.logs, lattice_lm.Mixture(bags_of(counts[:20])).logs, atol=1e-3)


def test_scores_of_classes_add_up(spark, monkeypatch):
    """A text between two classes scores the log of the sum over both; its words count for both by its shares."""
    monkeypatch.setattr(lattice_lm, "FREQUENT", 8)
    texts = {1: "a a b b", 3: "b b a a a", 4: "c c d d", 5: "d c c c", 6: "a c", 7: ""}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id bigint, text string")
    hashes = {w: int(lattice_lm.Words(*lattice_lm.text_bytes(lattice_lm.pa.array([w]))).hashes(np.frombuffer(w.encode(), np.uint8))[0]) for w in "abcd"}
    mixture = lattice_lm.Mixture(bags_of(np.zeros((0, lattice_lm.BUCKETS))))
    share = np.full((2, lattice_lm.BUCKETS), 0.01)
    for w, k in (("a", 0), ("b", 0), ("c", 1), ("d", 1)):
        share[k, hashes[w] % lattice_lm.BUCKETS] = 1
    mixture.prior, mixture.logs = np.log([0.5, 0.5]), np.log(share)
    monkeypatch.setattr(lattice_lm, "fit_classes", lambda rows: mixture)
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, PATH).collect()}
    table, post = lattice_lm.pieces(PATH), {}
    for i, t in texts.items():
        p = np.exp([sum(math.log(share[k, hashes[w] % lattice_lm.BUCKETS]) for w in t.split()) for k in range(2)])
        p /= p.sum()
        p[p < lattice_lm.LEAST] = 0
        post[i] = p / p.sum()
    assert post[6].tolist() == post[7].tolist() == [0.5, 0.5] and post[1].tolist() == [1, 0]
    trained = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = [{w: sum(post[d][k] * texts[d].split().count(w) for d in trained) for w in "abcd"} for k in range(2)]
    ends = np.array([sum(post[d][k] for d in trained) for k in range(2)])
    logs = lattice_lm.fit(spark.createDataFrame([(k, w, float(n)) for k in range(2) for w, n in c[k].items() if n], "kind int, word string, c double"), ends, PATH)
    for i, t in texts.items():
        total = 0.0
        for k in np.flatnonzero(post[i]):
            n, own = sum(c[k].values()), (ends[k] + 1) / (ends.sum() + 2) * ends[k] / (sum(c[k].values()) + ends[k])
            left = sum(min(x, 0.75) for x in c[k].values()) / n
            for w in t.split():
                own *= n / (n + ends[k]) * (max(0, c[k][w] - 0.75) / n + left * math.exp(lattice_lm.word_logs([w], table, logs[k])[0]))
            total += own
        assert got[i]["score"] == pytest.approx(math.log10(total))
        assert got[i]["n_tokens"] == len(t.split()) + 1 and got[i]["train_tokens"] == sum(len(texts[d].split()) + 1 for d in trained)
