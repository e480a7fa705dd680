"""Divisions of worlds in two, and how much the parts stick together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from .lookup import count, links_among, links_between
from .modal import truths
from .schemes import DEAD_END, PAIR, scheme


def dead_ends(graph: Graph) -> DataFrame:
    """(world, dead_end): whether a world has no link to another."""
    plain = graph.unreflexive()
    return truths(plain, [DEAD_END], plain.linked).select("world", F.col("f0").alias("dead_end"))


def community_and_loners(graph: Graph, scores: DataFrame, percent: int) -> DataFrame:
    """(world, community): whether some world's top formulas all hold here and one of them in a linked other world."""
    plain = graph.unreflexive()
    found = scheme(plain, "similar_successor", scores, percent).select("world").distinct().withColumn("community", F.lit(True))
    return plain.linked.join(found, "world", "left").select("world", F.coalesce("community", F.lit(False)).alias("community"))


def approximate_authorities(graph: Graph, scores: DataFrame, percent: int) -> DataFrame:
    """(world, authority): whether more than half of the diamonded top-score formulas are false in a world."""
    formulas = scheme_formulas(scores, percent)
    true = scheme(graph, "tfidf_top_ored_diamonded", scores, percent).groupBy("world").agg(count("held"))
    many = formulas.agg(F.count(F.lit(1)).alias("many"))
    false = F.col("many") - F.coalesce("held", F.lit(0))
    return graph.linked.join(true, "world", "left").join(F.broadcast(many)).select("world", (false > F.floor(F.col("many") / 2)).alias("authority"))  # many is one row


def scheme_formulas(scores: DataFrame, percent: int) -> DataFrame:
    from .tfidf import top_percent

    return top_percent(scores, percent).select(F.col("world").alias(PAIR[0])).distinct()


def interrelation(links: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: crossing links over the links that there could be; NaN for an empty part.  selectivity is 1 less that."""
    sizes = one.agg(F.count(F.lit(1)).alias("a")).join(other.agg(F.count(F.lit(1)).alias("b")))
    most = 2 * F.col("a") * F.col("b")
    found = links_between(links, one, other).agg(F.count(F.lit(1)).alias("n")).join(sizes)
    share = F.when(most == 0, F.lit(float("nan"))).otherwise(F.col("n") / F.when(most == 0, 1).otherwise(most))
    return found.select(share.alias("interrelation"), (1 - share).alias("selectivity"))


def average_links(links: DataFrame, part: DataFrame) -> DataFrame:
    """One row: links between different worlds of a part for each of its worlds."""
    n = part.agg(F.count(F.lit(1)).alias("worlds"))
    found = links_among(links, part).agg(F.count(F.lit(1)).alias("links")).join(n)
    return found.select(F.when(F.col("worlds") == 0, F.lit(float("nan"))).otherwise(F.col("links") / F.when(F.col("worlds") == 0, 1).otherwise(F.col("worlds"))).alias("average"))


def cliqueness(links: DataFrame, part: DataFrame) -> DataFrame:
    """One row: links between different worlds of a part over those of a clique; 1 for one world, null for none."""
    n = part.agg(F.count(F.lit(1)).alias("n"))
    found = links_among(links, part).agg(F.count(F.lit(1)).alias("links")).join(n)
    most = F.col("n") * (F.col("n") - 1)
    return found.select(F.when(F.col("n") == 1, 1.0).when(F.col("n") > 1, F.col("links") / F.when(most == 0, 1).otherwise(most)).alias("cliqueness"))
