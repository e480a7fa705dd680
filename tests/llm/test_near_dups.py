"""Near-duplicates and fingerprints against brute force."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from modalgraph.llm import near_dups, order_minhash
from pyspark.sql import functions as F

from .conftest import SCHEMA, prose


def shingles(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    """Probability Jaccard, by its definition."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in keys) for x in keys if a[x] and b[x])


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (Counter({k: rng.randint(1, 4) for k in rng.sample(range(12), rng.randint(1, 10))}) for _ in range(2))
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert near_dups.probability_jaccard(*pair) == pytest.approx(similarity(a, b))


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    keys = near_dups.mix(np.arange(300, dtype=np.uint64) + np.uint64(1))
    weight = rng.integers(1, 5, 300).astype(float)
    other = np.where(rng.random(300) < 0.3, weight + 2, weight)
    a, b = (keys[:250], weight[:250]), (keys[40:], other[40:])
    key, doc, w = np.concatenate([a[0], b[0]]), np.repeat([0, 1], [250, 260]), np.concatenate([a[1], b[1]])
    got = near_dups.probminhash(key, doc, w, 3, 4000)
    assert not got[2].any() and (got[:2] != 0).all()
    order = [np.argsort(x[0]) for x in (a, b)]
    exact = near_dups.probability_jaccard(*((x[0][o], x[1][o]) for x, o in zip((a, b), order, strict=True)))
    assert (got[0] == got[1]).mean() == pytest.approx(exact, abs=0.03)


def copies():
    rng = random.Random(9)
    rows, n = [], 0
    for family in range(25):
        base = prose(rng, rng.randint(80, 250)).split()
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = prose(rng, 1)
            if rng.random() < 0.2:
                words += words[:30]
            rows.append((n, " ".join(words)))
            n += 1
    # a chain whose ends are far apart
    words = prose(rng, 200).split()
    for i in range(12):
        rows.append((n, " ".join(words)))
        n += 1
        words[i * 15] = words[i * 15 + 7] = "changed"
    return rows


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and (sets[a] == sets[b] or similarity(sets[a], sets[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


@pytest.mark.parametrize(("leaders", "most"), [(0, 1_024), (0, 1), (2, 1_024)])
def test_classes_are_the_components(spark, monkeypatch, leaders, most):
    monkeypatch.setattr(near_dups, "LEADERS", leaders)
    monkeypatch.setattr(near_dups, "MOST", most)
    monkeypatch.setattr(near_dups, "PER_TASK", 3)
    rows = copies()
    docs = spark.createDataFrame([(d, t, 0, "", "", "", "", 0, 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == components(rows)
    kept = near_dups.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(got.values())


def test_blocks_join_classes_by_few_links():
    rng = random.Random(4)
    base = prose(rng, 120).split()
    texts = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{i}"
        texts.append(" ".join(words))
    texts += [prose(rng, 100) for _ in range(5)]
    block = [(0, i, i, t) for i, t in enumerate(texts[:10])] + [(1, i, i, t) for i, t in enumerate(texts)]
    links = near_dups._joining(block)
    root = list(range(45))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    assert len(set(root[:40])) == 1 and len(set(root)) == 6
    assert len(links) == 39


def test_blocks_compare_weights():
    text = " ".join(f"w{i % 7}" for i in range(60))
    block = [(0, 1, 1, text), (1, 2, 2, text + " w4 w5 w6"), (1, 3, 3, "w1 w2 w3 w4 w5")]
    want = [(1, 2)] if similarity(shingles(block[0][3]), shingles(block[1][3])) >= 0.8 else []
    assert near_dups._joining(block) == want != []


def test_odd_rows(odd, odd_rows):
    got = near_dups.classes(odd).collect()
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert by_id[20] == by_id[21] == by_id[22] == 20
    assert by_id[0] == by_id[24] == by_id[25] == 0
    assert by_id[23] == 23 and by_id[26] == 26
    assert by_id[29] == 3  # the same text twice: shingles weigh the same in proportion
    assert sorted(r["class_id"] for r in got if r["doc_id"] is None) == [1, 20]
    kept = near_dups.keep(odd)
    assert kept.schema == odd.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(21), 23, *range(26, 29)]


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(12)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (None, c), (None, c), (None, None), (None, "")]
    kept = near_dups.keep(spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n int")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("3", a), ("5", b), ("None", c), ("None", "")])


def test_texts_that_share_frequent_passages_do_not_meet(spark):
    rng = random.Random(13)
    passage = prose(rng, 150)
    alike = prose(rng, 80)
    texts = [passage + " " + prose(rng, 60) for _ in range(120)] + [passage + " " + alike + f" x{i}" for i in range(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "rep bigint, text string")
    groups = near_dups.rarest(rows).groupBy("bucket").agg(F.collect_set("rep").alias("reps")).collect()
    pairs = {(x, y) for r in groups for x in r["reps"] for y in r["reps"] if x < y}
    sets = [shingles(t) for t in texts]
    similar = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity_of_sets(sets[i], sets[j]) >= 0.8}
    assert similar == {(120, 121), (120, 122), (121, 122)} <= pairs
    assert len(pairs) < 200  # of 7,503


def similarity_of_sets(a, b):
    return len(a.keys() & b.keys()) / len(a.keys() | b.keys())


def test_recall_against_brute_force(spark):
    """Every document whose id is divisible by 100 against all rows: similar ones are of one class."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    of = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    rows = docs.orderBy("doc_id").toArrow()
    s, ids = near_dups.Shingles(rows.column("text").combine_chunks()), rows.column("doc_id").to_pylist()
    found = [of[ids[q]] == of[ids[i]] for q in range(len(ids)) if ids[q] % 100 == 0 for i in range(len(ids)) if i != q and near_dups.probability_jaccard(s.of(q), s.of(i)) >= 0.8]
    assert sum(found) >= 0.9 * len(found)


def test_no_rows(nothing):
    assert near_dups.classes(nothing).collect() == []
    assert near_dups.keep(nothing).collect() == []
    assert order_minhash.with_next(nothing.select("doc_id", "text")).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in near_dups.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# Order MinHash


def order_sketch(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["f"] for r in order_minhash.fingerprinted(df, "text", "f").orderBy("doc_id").collect()]


def brute_sketch(spark, text):
    """Every sample orders all k-mers anew, by plain loops, with the engine's hash for single values."""
    words = (text or "").strip(" \t\n\x0b\x0c\r").replace("\n", " ").split(" ")
    words = [w for w in words if w or len(words) == 1]
    hashed = lambda rows, kinds: [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}").coalesce(1).orderBy("i").select(F.xxhash64(*[k.split()[0] for k in kinds.split(", ")])).collect()]
    of_word = dict(zip(words, hashed([[w] for w in words], "a string"), strict=True))
    k = order_minhash.K
    runs = [[of_word[w] for w in words[i : i + k]] for i in range(max(1, len(words) - k + 1))]
    grams = hashed([r + [None] * (k - len(r)) for r in runs], ", ".join(f"c{i} bigint" for i in range(k)))
    seen, kmers = Counter(), []
    for g in grams:
        kmers.append(g if not seen[g] else hashed([[g, seen[g]]], "a bigint, b int")[0])
        seen[g] += 1
    rounds = range(order_minhash.SAMPLES)
    draws = iter(hashed([[x, j] for x in kmers for j in rounds], "a bigint, b bigint"))
    came = [{} for _ in rounds]
    for place, x in enumerate(kmers):
        for j in rounds:
            came[(x ^ j) % 64][place] = (j, next(draws) % 2**64)
    out = []
    for number, times in enumerate(came):
        assert len(times) == len(kmers)  # each k-mer comes to each sample once
        chosen = sorted(sorted(times, key=times.get)[: order_minhash.TUPLE])
        parts = [kmers[p] for p in chosen] + [None] * (order_minhash.TUPLE - len(chosen))
        out.append(parts)
    return [i << 32 | t & (2**32 - 1) for i, t in enumerate(hashed(out, "a bigint, b bigint"))]


@pytest.mark.parametrize("text", ["", "one", "a b c d e f g h", "x y z " * 9, "the cat sat on the mat and the cat sat on the mat again and again", prose(random.Random(2), 40), prose(random.Random(3), 700) + " again and again" * 20])
@pytest.mark.parametrize("arrivals", [(64, 128), order_minhash.ARRIVALS])
def test_every_sample_selects_from_all_kmers(spark, monkeypatch, text, arrivals):
    monkeypatch.setattr(order_minhash, "ARRIVALS", arrivals)  # with few, samples are not full and all rounds are drawn
    assert order_sketch(spark, [text])[0] == brute_sketch(spark, text)


def test_swapped_halves_of_short_texts_are_less_alike(spark):
    rng = random.Random(8)
    texts, sizes = [], (20, 40, 80, 160)
    for n in sizes:
        for _ in range(5):
            words = prose(rng, n).split()
            texts += [" ".join(words), " ".join(words[n // 2 :] + words[: n // 2])]
    found = order_sketch(spark, texts)
    likes = [len(set(a) & set(b)) / order_minhash.SAMPLES for a, b in zip(found[::2], found[1::2], strict=True)]
    for i, n in enumerate(sizes):
        both = ((n - 8) / n) ** 2  # about the share of samples with two k-mers that both texts have, half of them in another order
        assert np.mean(likes[5 * i : 5 * i + 5]) < 0.62 * both + 0.05


def test_likeness_follows_edits(spark):
    rng = random.Random(6)
    words = prose(rng, 800).split()
    small, half, moved = list(words), list(words), words[400:] + words[:400]
    small[10] = "edit"
    half[400:] = prose(rng, 400).split()
    shuffled = list(words)
    rng.shuffle(shuffled)
    texts = [" ".join(w) for w in (words, words, small, half, moved, shuffled)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    f = order_minhash.fingerprinted(df, "text", "f")
    base = f.filter("doc_id = 0").select(F.col("f").alias("g"))
    like = {r["doc_id"]: r["l"] for r in f.join(base).select("doc_id", order_minhash.likeness(F.col("f"), F.col("g")).alias("l")).collect()}
    assert like[0] == like[1] == 1.0
    assert like[2] > 0.9 > like[4] > like[5]
    assert 0 < like[3] < like[2]


def test_neighbours_and_edited_texts(spark, odd, tmp_path):
    odd.select("doc_id", "text").filter("doc_id <> 25 or doc_id is null").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in order_minhash.op7_order_minhash(spark, f"file://{tmp_path}").filter("doc_id is not null").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.filter("doc_id is not null").collect()}
    order = sorted((d for d in texts if d != 25), reverse=True)
    for one, other in zip(order, order[1:], strict=False):
        a, b = texts[one], texts[other]
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert got[one]["n_chars"] == len(a)
        assert got[one]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[one]["near_next"] <= 1 and 0 <= got[one]["near_edited"] <= 1
    assert got[24]["fingerprint"] == got[0]["fingerprint"]
    assert got[20]["fingerprint"] == got[21]["fingerprint"] and got[21]["near_next"] == 1.0


def test_a_single_document_is_its_own_neighbour(spark):
    docs = spark.createDataFrame([(5, "a b c")], "doc_id bigint, text string")
    assert [r["next_text"] for r in order_minhash.with_next(docs).collect()] == ["a b c"]


@pytest.mark.parametrize("case", ["plain", "hot", "nulls", "all null", "one id", "repeats"])
def test_neighbours_of_hot_and_null_ids(spark, case):
    rng = random.Random(21)
    ids = {"plain": range(40), "hot": [7] * 30 + [*range(20)], "nulls": [None] * 30 + [*range(10)], "all null": [None] * 25, "one id": [3] * 25, "repeats": [1, 1, 2, 2, None, None]}[case]
    rows = [(d, "same text" if case == "repeats" else prose(rng, 3)) for d in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in order_minhash.with_next(docs).collect()) == want
    starts = order_minhash.range_starts(docs, 4)
    assert len(starts) <= 9 and (len({s[0] for s in starts}) < len(starts)) == (case not in ("plain", "repeats"))


def test_arrow_column_slices():
    column = pa.array(["zz", None, "a b c d e f", "", "x"])[1:]
    s = near_dups.Shingles(column)
    assert np.diff(s.first).tolist() == [0, 2, 0, 1]
