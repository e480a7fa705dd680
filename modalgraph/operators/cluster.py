"""Clusters of worlds: statistics, k-means in a boolean space of formulas, its splitting and merging form, single link.

Positions are kept sparsely as (world, dim), the formulas that are true; clusters as (cluster, world), centroids as (cluster, dim).
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import Formula
from ..functions.measure import centroid_quality, clique_edges, jaccard_counts
from ..model import Graph
from ..sources.shared import saved
from .modal import truths
from .traverse import connected

SPLIT_BELOW, MERGE_BELOW = 0.2, 0.8


def positions(graph: Graph, formulas: Sequence[Formula]) -> DataFrame:
    """(world, dim): the numbers of the formulas that are true in each linked world."""
    found = truths(graph, formulas, graph.linked)
    dims = F.array(*(F.when(F.col(f"f{i}"), F.lit(i)) for i in range(len(formulas))))
    return found.select("world", F.explode(F.filter(dims, lambda d: d.isNotNull())).alias("dim"))


# statistics


def _sizes(lam: DataFrame, worlds: DataFrame) -> DataFrame:
    """(world, size): how many formulas each of the worlds has."""
    own = lam.groupBy("world").agg(F.count(F.lit(1)).alias("size"))
    return worlds.select("world").distinct().join(own, "world", "left").select("world", F.coalesce("size", F.lit(0)).alias("size"))


def pair_similarities(lam: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, a, b, sim) of worlds of one cluster, a before b, that share a formula or both have none."""
    sized = clusters.join(_sizes(lam, clusters), "world")
    terms = clusters.join(lam.select("world", "formula"), "world")
    left, right = terms.select("cluster", "formula", F.col("world").alias("a")), terms.select("cluster", "formula", F.col("world").alias("b"))
    shared = left.join(right, ["cluster", "formula"]).filter("a < b").groupBy("cluster", "a", "b").agg(F.count(F.lit(1)).alias("shared"))
    side = lambda w: sized.select("cluster", F.col("world").alias(w), F.col("size").alias(f"n{w}"))
    sims = shared.join(side("a"), ["cluster", "a"]).join(side("b"), ["cluster", "b"]).select("cluster", "a", "b", jaccard_counts(F.col("shared"), F.col("na"), F.col("nb")).alias("sim"))
    bare = sized.filter("size = 0")
    empty = bare.select("cluster", F.col("world").alias("a")).join(bare.select("cluster", F.col("world").alias("b")), "cluster").filter("a < b")
    return sims.union(empty.select("cluster", "a", "b", F.lit(1.0)))


def similarities(lam: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n, sim): the mean similarity of different worlds of a cluster; null for fewer than two."""
    sums = pair_similarities(lam, clusters).groupBy("cluster").agg(F.sum("sim").alias("total"))
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    pairs = clique_edges(F.col("n")) / 2
    return n.join(sums, "cluster", "left").select("cluster", "n", F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / F.when(F.col("n") > 1, pairs).otherwise(1)).alias("sim"))


def dissimilarities(lam: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, dissim) of different clusters: 1 less the similarity of their worlds' formulas together."""
    together = clusters.join(lam.select("world", "formula"), "world").select("cluster", "formula").distinct()
    own = clusters.select("cluster").distinct().join(together.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"))
    pairs = own.select(F.col("cluster").alias("a"), F.col("size").alias("na")).join(own.select(F.col("cluster").alias("b"), F.col("size").alias("nb")), F.col("a") != F.col("b"))  # each pair is a result
    shared = together.withColumnRenamed("cluster", "a").join(together.withColumnRenamed("cluster", "b"), "formula").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", (1 - jaccard_counts(F.coalesce("shared", F.lit(0)), F.col("na"), F.col("nb"))).alias("dissim"))


def cliquenesses(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, cliqueness): links between different worlds of a cluster over those of a clique; 1 for one world."""
    ends = links.filter("source <> target").join(clusters.withColumnRenamed("world", "source"), "source").join(clusters.select(F.col("world").alias("target"), F.col("cluster").alias("other")), "target")
    inside = ends.filter("cluster = other").groupBy("cluster").agg(F.count(F.lit(1)).alias("links"))
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    most = clique_edges(F.col("n"))
    return n.join(inside, "cluster", "left").select("cluster", F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("links", F.lit(0)) / F.when(most == 0, 1).otherwise(most)).alias("cliqueness"))


def statistics(graph: Graph, clusters: DataFrame) -> DataFrame:
    """(cluster, n, sim, cliqueness)."""
    return similarities(graph.lam, clusters).join(cliquenesses(graph.links, clusters), "cluster").select("cluster", "n", "sim", "cliqueness")


def averages(graph: Graph, clusters: DataFrame) -> DataFrame:
    """One row: mean similarity of the clusters that have one, dissimilarity over all pairs, mean cliqueness."""
    means = statistics(graph, clusters).agg(F.avg("sim").alias("avg_sim"), F.avg("cliqueness").alias("avg_cliqueness"))
    apart = dissimilarities(graph.lam, clusters).agg((F.sum("dissim") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_dissim"))
    return means.join(apart)


# k-means


def random_centroids(dims: int, k: int, seed: int = 0, tries: int = 20) -> list[list[bool]]:
    """Boolean centroids, drawn anew until they are good enough or the tries are used up."""
    draw = random.Random(seed)
    for _ in range(tries + 1):
        found = [[draw.random() < 0.5 for _ in range(dims)] for _ in range(k)]
        if centroid_quality(found):
            break
    return found


def centroid_table(spark: SparkSession, centroids: Sequence[Sequence[bool]]) -> DataFrame:
    """(cluster, dim): the true coordinates of centroids, and for each a row without a dim, so that none is lost."""
    return spark.createDataFrame([(k, d) for k, c in enumerate(centroids) for d in (None, *(i for i, b in enumerate(c) if b))], "cluster int, dim int")


def assigned(worlds: DataFrame, places: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, world): the first of the nearest centroids (cluster, dim).

    The distance to a centroid grows with |c| - 2 |p and c|.  Of the centroids that share no coordinate with a world only the
    first of the smallest can be the nearest, so worlds only meet centroids that they share one with, and that one.
    """
    sizes = centroids.groupBy("cluster").agg(F.count("dim").alias("size"))
    shared = places.join(worlds, "world", "left_semi").join(centroids, "dim").groupBy("world", "cluster").agg(F.count(F.lit(1)).alias("shared")).join(sizes, "cluster")
    near = shared.select("world", F.struct((F.col("size") - 2 * F.col("shared")).alias("far"), "cluster").alias("to"))
    least = sizes.agg(F.min(F.struct(F.col("size").alias("far"), "cluster")).alias("to"))  # one row
    return near.union(worlds.select("world").join(F.broadcast(least))).groupBy("world").agg(F.min("to").alias("to")).select("to.cluster", "world")


def majorities(clusters: DataFrame, places: DataFrame) -> DataFrame:
    """(cluster, dim): the coordinates true in at least half of a cluster's worlds, and for each cluster a row without one."""
    n = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    true = clusters.join(places, "world").groupBy("cluster", "dim").agg(F.count(F.lit(1)).alias("t")).join(n, "cluster").filter("2 * t >= n")
    return true.select("cluster", "dim").union(n.select("cluster", F.lit(None).cast("int")))


def _same(one: DataFrame, other: DataFrame) -> bool:
    return not one.subtract(other).union(other.subtract(one)).limit(1).count()


def k_means(worlds: DataFrame, places: DataFrame, centroids: Sequence[Sequence[bool]], rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(clusters, centroids) when centroids stop moving or rounds are used up; an empty cluster keeps its centroid.

    Clusters are (cluster, world), centroids (cluster, dim) as ``centroid_table`` has them.
    """
    current = centroid_table(worlds.sparkSession, centroids)
    clusters = assigned(worlds, places, current)
    for i in range(rounds):
        clusters = saved(clusters if not i else assigned(worlds, places, current), "clusters")
        moved = majorities(clusters, places)
        moved = saved(moved.union(current.join(clusters, "cluster", "left_anti").select("cluster", "dim")), "centroids")
        if _same(moved, current):
            break
        current = moved
    return clusters, current


def split(lam: DataFrame, clusters: DataFrame, below: float = SPLIT_BELOW) -> DataFrame:
    """Clusters less similar than that give up the fewest first worlds (by name) that leave the others similar enough.

    The similarity of the last worlds of a cluster is a running sum over the similarities of each world with later ones.
    """
    low = similarities(lam, clusters).filter(F.col("sim") < below).select("cluster")
    loose = clusters.join(low, "cluster", "left_semi")
    later = pair_similarities(lam, loose).groupBy("cluster", F.col("a").alias("world")).agg(F.sum("sim").alias("later"))
    rows = loose.join(later, ["cluster", "world"], "left")
    own = Window.partitionBy("cluster").orderBy("world")
    ranked = rows.select("cluster", "world", F.row_number().over(own).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("cluster")).alias("n"), F.sum(F.coalesce("later", F.lit(0.0))).over(own.rowsBetween(0, Window.unboundedFollowing)).alias("rest"))
    left = F.col("n") - F.col("rank") + 1
    enough = (F.col("rank") > 1) & (left > 1) & (F.col("rest") / F.when(left > 1, left * (left - 1) / 2).otherwise(1) >= below)
    cut = ranked.filter(enough).groupBy("cluster").agg(F.min("rank").alias("cut"))
    moved = ranked.join(cut, "cluster").filter("rank >= cut").select("cluster", "world", F.lit(1).alias("half"))
    return clusters.join(moved, ["cluster", "world"], "left").select("cluster", F.coalesce("half", F.lit(0)).alias("half"), "world")


def merge_pairs(lam: DataFrame, clusters: DataFrame, below: float = MERGE_BELOW) -> list[tuple[int, int]]:
    """Each cluster with the first one at a dissimilarity over 0 and below that; pairs that share one with an earlier pair go."""
    near = dissimilarities(lam, clusters).filter((F.col("dissim") > 0) & (F.col("dissim") < below)).groupBy("a").agg(F.min("b").alias("b")).orderBy("a").collect()
    used: set[int] = set()
    out = []
    for r in near:  # one row for each cluster
        if r["a"] not in used and r["b"] not in used:
            out.append((r["a"], r["b"]))
            used |= {r["a"], r["b"]}
    return out


def _renumbered(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters numbered anew by their keys, without gaps."""
    numbers = clusters.select(keys).distinct().withColumn("number", F.row_number().over(Window.orderBy(*keys)) - 1)  # one row for each cluster
    return clusters.join(numbers, keys).select(F.col("number").alias("cluster"), "world")


def dynamic_k_means(graph: Graph, worlds: DataFrame, places: DataFrame, centroids: Sequence[Sequence[bool]], rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """k-means that drops empty clusters, splits loose ones and merges close ones each round; centroids follow the clusters."""
    spark = worlds.sparkSession
    clusters = saved(_renumbered(assigned(worlds, places, centroid_table(spark, centroids)), ["cluster"]), "clusters")
    current = saved(majorities(clusters, places), "centroids")
    for _ in range(rounds):
        clusters = saved(_renumbered(assigned(worlds, places, current), ["cluster"]), "clusters")
        clusters = saved(_renumbered(split(graph.lam, clusters), ["cluster", "half"]), "clusters")
        pairs = merge_pairs(graph.lam, clusters)
        if pairs:
            into = spark.createDataFrame([(b, a) for a, b in pairs], "cluster int, into int")
            merged = clusters.join(into, "cluster", "left").select(F.coalesce("into", "cluster").alias("cluster"), "world")
            clusters = saved(_renumbered(merged, ["cluster"]), "clusters")
        moved = saved(majorities(clusters, places), "centroids")
        if _same(moved, current):
            break
        current = moved
    return clusters, current


# single link


def single_link_edges(worlds: DataFrame, places: DataFrame) -> DataFrame:
    """(level, source, target, dist): all pairs of worlds by the rank of their distance; every pair is a result."""
    size = places.groupBy("world").agg(F.count(F.lit(1)).alias("size"))
    sized = worlds.join(size, "world", "left").select("world", F.coalesce("size", F.lit(0)).alias("size"))
    side = lambda w: sized.select(F.col("world").alias(w), F.col("size").alias(f"n_{w}"))
    pairs = side("source").join(side("target"), F.col("source") < F.col("target"))
    of = lambda w: places.select(F.col("world").alias(w), "dim")
    shared = of("source").join(of("target"), "dim").filter("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared"))
    apart = pairs.join(shared, ["source", "target"], "left").select("source", "target", (F.col("n_source") + F.col("n_target") - 2 * F.coalesce("shared", F.lit(0))).alias("apart"))
    apart = saved(apart, "distances")
    levels = apart.select("apart").distinct().select("apart", F.row_number().over(Window.orderBy("apart")).cast("bigint").alias("level"))  # at most one row for each number of formulas
    return apart.join(F.broadcast(levels), "apart").select("level", "source", "target", F.sqrt(F.col("apart").cast("double")).alias("dist"))


def single_link_hierarchy(worlds: DataFrame, places: DataFrame, levels: int | None = None) -> DataFrame:
    """(level, label, world): the components that links up to each level make; a level that changes nothing is left out.

    Each level only joins components of the one before: its links become links between their labels.
    """
    edges = saved(single_link_edges(worlds, places), "links")
    ends = edges.select("level", F.explode(F.array("source", "target")).alias("world")).groupBy("world").agg(F.min("level").alias("first"))
    labels = saved(ends.select("world", "first", F.col("world").alias("label")), "labels")
    last = edges.agg(F.max("level")).head()[0] or 0
    done = None
    for level in range(1, min(last, levels or last) + 1):
        of = lambda end, labels=labels: labels.select(F.col("world").alias(end), F.col("label").alias(f"of_{end}"))
        between = edges.filter(F.col("level") == level).join(of("source"), "source").join(of("target"), "target").filter("of_source <> of_target")
        between = saved(between.select(F.col("of_source").alias("source"), F.col("of_target").alias("target")).distinct(), "between")
        if not between.limit(1).count():
            continue
        joined = connected(between).select(F.col("world").alias("label"), F.col("label").alias("into"))
        labels = saved(labels.join(joined, "label", "left").select("world", "first", F.coalesce("into", "label").alias("label")), "labels")
        found = labels.filter(F.col("first") <= level).select(F.lit(level).cast("bigint").alias("level"), "label", "world")
        done = found if done is None else done.union(found)
        if labels.select("label").distinct().limit(2).count() == 1:
            break
    return done if done is not None else edges.select("level", F.col("source").alias("label"), F.col("target").alias("world"))
