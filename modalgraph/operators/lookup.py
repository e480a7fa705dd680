"""Lookups, set queries and counts over links and formulas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import nodes


def _is_in(column: str, values: Sequence[str]) -> Column:
    """Membership that is false, not null, for an empty list."""
    return F.col(column).isin(list(values)) if values else F.lit(False)


def count(name: str) -> Column:
    return F.count(F.lit(1)).cast("bigint").alias(name)


# links


def sources_in_links(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").alias("world")).distinct()


def worlds_in_links(links: DataFrame) -> DataFrame:
    return nodes(links)


def targets_of(links: DataFrame, world: str) -> DataFrame:
    return links.filter(F.col("source") == world).select(F.col("target").alias("world"))


def sources_of(links: DataFrame, world: str) -> DataFrame:
    return links.filter(F.col("target") == world).select(F.col("source").alias("world"))


def links_from(links: DataFrame, worlds: Sequence[str], reflexive: bool = True) -> DataFrame:
    found = links.filter(_is_in("source", worlds))
    return found if reflexive else found.filter("source <> target")


def links_to(links: DataFrame, worlds: Sequence[str], reflexive: bool = True) -> DataFrame:
    found = links.filter(_is_in("target", worlds))
    return found if reflexive else found.filter("source <> target")


def out_link_count(links: DataFrame, world: str) -> DataFrame:
    return links.filter(F.col("source") == world).agg(count("n"))


def with_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links and new ones, each once; a link that is there already is no error."""
    return links.select("source", "target").union(new.select("source", "target")).distinct()


def degree_distribution(links: DataFrame, end: str) -> DataFrame:
    """(degree, worlds): how many worlds have so many links with themselves at ``end`` (source or target)."""
    return links.groupBy(end).agg(count("degree")).groupBy("degree").agg(count("worlds"))


def links_among(links: DataFrame, worlds: DataFrame, reflexive: bool = False) -> DataFrame:
    """Links with both ends among ``worlds``."""
    inside = links.join(worlds.select(F.col("world").alias("source")), "source", "left_semi").join(worlds.select(F.col("world").alias("target")), "target", "left_semi")
    inside = inside.select("source", "target")
    return inside if reflexive else inside.filter("source <> target")


def links_between(links: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """Links from one set of worlds to the other, either way."""
    there = links.join(one.select(F.col("world").alias("source")), "source", "left_semi").join(other.select(F.col("world").alias("target")), "target", "left_semi")
    back = links.join(other.select(F.col("world").alias("source")), "source", "left_semi").join(one.select(F.col("world").alias("target")), "target", "left_semi")
    return there.select("source", "target").union(back.select("source", "target")).distinct()


# formulas


def world_formulas(lam: DataFrame, world: str) -> DataFrame:
    return lam.filter(F.col("world") == world).select("formula")


def world_formula_counts(lam: DataFrame, world: str) -> DataFrame:
    return lam.filter(F.col("world") == world).select("formula", F.col("frmcount").cast("bigint").alias("frmcount"))


def term_frequency(lam: DataFrame, world: str, formula: str) -> DataFrame:
    """One row: the count of a formula in a world, 0 if it does not hold there."""
    return lam.filter((F.col("world") == world) & (F.col("formula") == formula)).agg(F.coalesce(F.max("frmcount"), F.lit(0)).cast("bigint").alias("n"))


def document_frequency(lam: DataFrame, formula: str) -> DataFrame:
    return lam.filter(F.col("formula") == formula).agg(count("n"))


def world_count(lam: DataFrame) -> DataFrame:
    return lam.agg(F.countDistinct("world").cast("bigint").alias("n"))


def worlds_with_formula(lam: DataFrame, formula: str) -> DataFrame:
    return lam.filter(F.col("formula") == formula).select("world")


def holding(lam: DataFrame, atoms: Sequence[str], form: Callable[[str, str | None], str] | None = None, languages: DataFrame | None = None, stem_languages: Sequence[str] = ()) -> DataFrame:
    """(world, atom, frmcount) of the worlds in which atoms hold.

    With a ``form`` an atom is asked for in the form it has in each world's language, by ``languages`` (world, language); worlds of
    no known language have the form of none.
    """
    if form is None:
        return lam.filter(_is_in("formula", atoms)).select("world", F.col("formula").alias("atom"), "frmcount")
    asked = [("" if x is None else x, form(a, x), a) for x in (None, *stem_languages) for a in dict.fromkeys(atoms)]
    forms = lam.sparkSession.createDataFrame(asked, "language string, formula string, atom string")  # one row for each atom and language
    named = lam.filter(_is_in("formula", sorted({f for _, f, _ in asked}))).join(languages, "world", "left").withColumn("language", F.coalesce("language", F.lit("")))
    return named.join(F.broadcast(forms), ["language", "formula"]).select("world", "atom", "frmcount")


def worlds_in_lambda(lam: DataFrame) -> DataFrame:
    return lam.select("world").distinct()


def formulas_in_lambda(lam: DataFrame) -> DataFrame:
    return lam.select("formula").distinct()


def worlds_intersecting(lam: DataFrame, visited: Sequence[str], world: str) -> DataFrame:
    """Unvisited worlds that share a formula with a world."""
    return lam.filter(~_is_in("world", visited)).join(world_formulas(lam, world), "formula", "left_semi").select("world").distinct()


def without_worlds(lam: DataFrame, worlds: Sequence[str]) -> DataFrame:
    """Labelled worlds that are not listed; an empty list takes away nothing."""
    return lam.select("world").distinct().filter(~_is_in("world", worlds))


def accumulated(lam: DataFrame) -> DataFrame:
    """(formula, total, share): each formula's count over all worlds and its share of all counts."""
    totals = lam.groupBy("formula").agg(F.sum("frmcount").cast("bigint").alias("total"))
    everything = lam.agg(F.sum("frmcount").cast("double").alias("everything"))
    return totals.join(F.broadcast(everything)).select("formula", "total", (F.col("total") / F.col("everything")).alias("share"))  # one row on the right


def with_counts(lam: DataFrame, new: DataFrame) -> DataFrame:
    """Formulas with new counts added: a pair that is there already gets the sum."""
    cols = ["world", "formula", "frmcount"]
    return lam.select(cols).union(new.select(cols)).groupBy("world", "formula").agg(F.sum("frmcount").cast("bigint").alias("frmcount"))


def with_replaced_counts(lam: DataFrame, new: DataFrame) -> DataFrame:
    """Formulas whose counts are replaced where ``new`` has the pair; pairs that are not there are not added."""
    given = new.select("world", "formula", F.col("frmcount").alias("given"))
    return lam.join(given, ["world", "formula"], "left").select("world", "formula", F.coalesce("given", "frmcount").cast("bigint").alias("frmcount"))


def without_world(lam: DataFrame, world: str) -> DataFrame:
    return lam.filter(F.col("world") != world)


def stem_language(languages: DataFrame, world: str) -> DataFrame:
    """One row: a world's language, the empty string if it has none."""
    return languages.filter(F.col("world") == world).agg(F.coalesce(F.max("language"), F.lit("")).alias("language"))


# sets of items by key: formulas of worlds, targets of sources, sources of targets


def subset_keys(pairs: DataFrame, key: str, item: str, items: Sequence[str]) -> DataFrame:
    """Keys all of whose items are listed (and that have any); nothing for an empty list."""
    return pairs.groupBy(F.col(key).alias("world")).agg(F.bool_and(_is_in(item, items)).alias("inside")).filter("inside").select("world")


def touching_keys(pairs: DataFrame, key: str, item: str, items: Sequence[str]) -> DataFrame:
    """Keys some of whose items are listed."""
    return pairs.filter(_is_in(item, items)).select(F.col(key).alias("world")).distinct()
