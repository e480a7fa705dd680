"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text's k-mers are its runs of ``K`` words (``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one k-mer, an empty text has one
empty word), each numbered by its occurrence so that repeats differ.  Each of ``SAMPLES`` samples orders all k-mers of the text
in a way of its own, takes the ``TUPLE`` least, puts them back into the order they have in the text, and hashes them as a tuple.
Likeness is the share of samples whose tuples agree: moving, replacing or repeating k-mers changes tuples, so it falls with edit
distance.

The orders come from arrivals: a k-mer arrives once in each of ``SAMPLES`` rounds, at a hashed time within the round, each time
at another sample, its own first one XOR the round.  So the time at which it comes to a sample is any of the rounds and
any time in it, alike for all samples, and a sample takes those that come first.  As a sample is full after two arrivals, only
as many rounds are drawn, or of long texts such a part of the first one, as bring ``ARRIVALS[0]`` arrivals.  Where a sample is not
full then, more are drawn, and at last all rounds.

Each row is worked on by itself in array functions.  The only exchange deals documents by ranges of doc_id to find each one's
neighbour.

Defined results: a null text is an empty one; a text with a single k-mer has it alone in all samples; equal texts have equal
fingerprints; documents of equal or null ids are ordered by their text's hash, null ids after all others; the document after the
last is the first, so a single one is its own neighbour; an empty table gives no rows; other columns are ignored.  Occurrences are numbered by 33 bits of a k-mer's hash.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, source_table

K, SAMPLES, TUPLE = 5, 64, 2
#: Arrivals drawn: a sample of them has fewer than two with a probability of 1e-4, and then of 1e-19.
ARRIVALS = (12 * SAMPLES, 48 * SAMPLES)
#: An arrival is packed as sample, time and place in 6, 26 and 32 bits.
_SAMPLE, _MIDDLE, _LOW = 58, ((1 << 26) - 1) << 32, (1 << 31) - 1


def _shifted(way: str, value: Column, bits: Column) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def _drawn(df: DataFrame, own: list[str], arrivals: int | None) -> DataFrame:
    """Adds ``__a``, arrivals of the k-mers ``__k``, packed and sorted, where the samples ``__g`` are not full.

    They are those of as many rounds as bring ``arrivals`` (all if None), or of a part of the first.
    """
    n, kept = F.size("__k"), ("__k", "__p", "__m", "__g")
    rounds = F.lit(SAMPLES) if arrivals is None else F.least(F.ceil(F.lit(arrivals) / n).cast("int"), F.lit(SAMPLES))
    bits = F.ceil(F.log2(rounds)).cast("int")
    # what is the same for all k-mers is bound in arrays, as a column used once would be computed within the loop over them
    turns = F.transform(F.sequence(F.lit(0), rounds - 1), lambda t: F.struct(t.cast("long").alias("t"), _shifted("left", t.cast("long"), _SAMPLE - bits).alias("s"), (bits + (64 - _SAMPLE)).alias("v")))

    def arrival(x: Column, i: Column, turn: Column) -> Column:
        at = F.shiftleft(x.bitwiseXOR(turn["t"]), _SAMPLE)  # the lowest bits are the sample
        part = _shifted("rightunsigned", F.xxhash64(x, turn["t"]), turn["v"]).bitwiseAND(F.lit(_MIDDLE))
        return at.bitwiseOR(turn["s"]).bitwiseOR(part).bitwiseOR(i)

    drawn = F.flatten(F.transform(turns, lambda turn: F.transform("__k", lambda x, i: arrival(x, i, turn))))
    if arrivals is not None:
        zero, kmer = F.lit(0).cast("long"), lambda i: F.get(F.col("__k"), i)
        bound = F.array(F.struct((F.lit(arrivals * 2.0**63) / n).cast("long").alias("e"), F.floor(F.log2(n / F.lit(arrivals))).cast("int").alias("z")))
        early = lambda b: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.shiftrightunsigned(F.xxhash64(kmer(i), zero), 1) < b["e"])
        soon = lambda i, b: F.shiftrightunsigned(_shifted("left", F.xxhash64(kmer(i), zero), b["z"]), 64 - _SAMPLE).bitwiseAND(F.lit(_MIDDLE))
        some = F.transform(bound, lambda b: F.transform(early(b), lambda i: F.shiftleft(kmer(i), _SAMPLE).bitwiseOR(soon(i, b)).bitwiseOR(i)))
        drawn = F.when(n > arrivals, F.get(some, 0)).otherwise(drawn)
    full = F.coalesce(F.size("__g") == F.col("__m") * SAMPLES, F.lit(False))
    return df.select(*own, *kept, F.when(~full, F.sort_array(drawn)).alias("__a"))


def numbered(df: DataFrame, own: list[str]) -> DataFrame:
    """Replaces ``__k``, hashes of k-mers, by hashes of k-mers with their occurrence; adds ``__p``, their places, or null if they are in order.

    Only texts with repeated k-mers sort them, packed with their places, to number their occurrences.
    """
    pairs = F.sort_array(F.transform("__k", lambda h, i: h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i)))
    df = df.select(*own, "__k", F.when(F.size(F.array_distinct("__k")) < F.size("__k"), pairs).alias("__s"))
    of = lambda i: F.shiftright(F.get(F.col("__s"), i), 31)
    place = lambda i: F.get(F.col("__s"), i).bitwiseAND(F.lit(_LOW)).cast("int")
    kmer = lambda i: F.get(F.col("__k"), place(i))
    heads = F.filter(F.sequence(F.lit(0), F.size("__s") - 1), lambda i: (i == 0) | (of(i) != of(i - 1)))
    df = df.select(*own, "__k", "__s", F.when(F.col("__s").isNotNull(), heads).alias("__h"))

    def occurrences(head: Column, i: Column) -> Column:
        last = F.coalesce(F.get(F.col("__h"), i + 1), F.size("__s")) - 1
        return F.transform(F.sequence(head, last), lambda j: F.when(j == head, kmer(j)).otherwise(F.xxhash64(kmer(j), j - head)))

    renamed = F.when(F.col("__s").isNull(), F.col("__k")).otherwise(F.flatten(F.transform("__h", occurrences)))
    return df.select(*own, renamed.alias("__k"), F.transform("__s", lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int")).alias("__p"))


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, the fingerprint as an array of longs (sample << 32 | tuple hash), of the string column ``text``."""
    own = [c for c in df.columns if c != out]
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[ \\x09-\\x0D]+")
    df = df.select(*own, F.transform(words, lambda w: F.xxhash64(w)).alias("__w"))
    runs = F.sequence(F.lit(0), F.greatest(F.size("__w") - K, F.lit(0)))
    df = numbered(df.select(*own, F.transform(runs, lambda i: F.xxhash64(*(F.get(F.col("__w"), i + k) for k in range(K)))).alias("__k")), own)
    many = F.least(F.size("__k"), F.lit(TUPLE))
    df = df.select(*own, "__k", "__p", many.alias("__m"), F.lit(None).cast("array<bigint>").alias("__g"))
    of = lambda x: F.shiftrightunsigned(x, _SAMPLE)
    for arrivals in (*ARRIVALS, None):
        df = _drawn(df, own, arrivals)
        first = F.filter("__a", lambda x, i: (i < TUPLE) | (of(x) != of(F.get(F.col("__a"), i - TUPLE))))
        df = df.select(*own, "__k", "__p", "__m", F.when(F.col("__a").isNull(), F.col("__g")).otherwise(first).alias("__g"))
    at = lambda j: F.get(F.col("__g"), j).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    place = lambda i: F.coalesce(F.get(F.col("__p"), i), i)
    kmer = lambda i: F.get(F.col("__k"), i)

    def tupled(sample: Column) -> Column:
        run = sample.bitwiseXOR(F.lit(SAMPLES // 2))  # packed arrivals sort as signed numbers
        one = at(run * F.col("__m"))
        other = F.when(F.col("__m") == TUPLE, at(run * TUPLE + 1))
        in_order = other.isNull() | (place(one) < place(other))
        pair = F.when(in_order, F.xxhash64(kmer(one), kmer(other))).otherwise(F.xxhash64(kmer(other), kmer(one)))
        return F.shiftleft(sample.cast("long"), 32).bitwiseOR(pair.bitwiseAND(F.lit((1 << 32) - 1)))

    return df.select(*own, F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), tupled).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of samples in which two fingerprint arrays agree."""
    return F.size(F.array_intersect(a, b)) / F.lit(SAMPLES)


def as_text(a: Column) -> Column:
    """Ten hexadecimal digits for each sample: two of the sample, eight of its tuple."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 10, "0")), ""))


_LEAST = -(1 << 63)


def range_starts(docs: DataFrame, n: int) -> list[tuple[int | None, int, bool]]:
    """Where about n ranges of documents begin, as (doc_id, text hash, whether that hash has to be met), by descending id, nulls last.

    Ranges begin at ids that occur.  An id that more than one range would begin at, or null if so many rows have it, has ranges of
    its own, by equal parts of the hashes of its texts; these begin at the least hash that occurs in each.
    """
    got = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n), F.max("doc_id"), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).head()
    often = Counter(got[0] or [])
    parts: dict[int | None, int] = {v: many for v, many in often.items() if many > 1}
    if got[2] and (nulls := round(n * got[3] / got[2])) > 1:
        parts[None] = nulls
    starts = [(v, _LEAST, False) for v in {*often, *([] if got[1] is None else [got[1]])} - parts.keys()]
    if parts:
        many = docs.sparkSession.createDataFrame(list(parts.items()), "hot long, parts int")
        hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(many), F.col("doc_id").eqNullSafe(F.col("hot")))
        own = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("parts"))
        starts += [(r["hot"], r["h"], True) for r in hashed.groupBy("hot", own.alias("part")).agg(F.min("h").alias("h")).collect()]  # at most n rows
    return sorted(starts, key=lambda s: (s[0] is None, -(s[0] or 0), s[1])) or [(None, _LEAST, False)]


def with_next(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) beside the text and fingerprint of the next one, by descending doc_id, the first after the last.

    A document at which a range begins is also sent, as a ghost, to the range before it, so every neighbour is found in one
    exchange.
    """
    spark, n = docs.sparkSession, partitions(docs)
    found = range_starts(docs, n)
    # a key for each range that hash partitioning sends to a partition of its own
    keyed = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("key")).collect()
    key_of = {r["to"]: r["key"] for r in keyed}
    keys = F.array(*(F.lit(key_of.get(k % n, k) + (0 if k < n else 64 * n * (k // n))).cast("long") for k in range(len(found))))
    starts = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("h"), F.lit(met).alias("met")) for i, h, met in found))
    own, h = F.col("doc_id"), F.xxhash64("text")
    begun = lambda s: F.when(s["id"].isNull(), own.isNull() & (s["h"] <= h)).otherwise(own.isNull() | (s["id"] > own) | ((s["id"] == own) & (s["h"] <= h)))
    home = F.greatest(F.size(F.filter(starts, begun)) - 1, F.lit(0))
    place = F.array_position(F.transform(starts, lambda s: s["id"].eqNullSafe(own) & (~s["met"] | (s["h"] == h))), True).cast("int")
    ghost = F.when(place == 1, F.lit(len(found) - 1)).when(place > 1, place - 2)
    sent = docs.select("doc_id", "text", F.posexplode(F.filter(F.array(home, ghost), lambda x: x.isNotNull())).alias("ghost", "range"))
    dealt = sent.select("doc_id", "text", "ghost", F.get(keys, F.col("range")).alias("range")).repartition(n, "range")
    dealt = fingerprinted(dealt, "text", "own")
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return dealt.withColumns({"next_text": F.lead("text").over(order), "next": F.lead("own").over(order)}).filter("ghost = 0").drop("ghost", "range")


def op7_order_minhash(spark, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    both = with_next(docs).select("doc_id", size.cast("long").alias("n_chars"), "own", "next", edited.alias("edited"))
    done = fingerprinted(both, "edited", "changed")
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
