"""Rings, paths and link scores.  Rounds pass on their results through tables in the shared folder."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import Graph, nodes
from ..sources.shared import saved

DAMPING = 0.85


def link_rings(links: DataFrame, world: str, outward: bool = True, limit: int | None = None) -> DataFrame:
    """(ring, world): worlds by their distance from (or, inward, to) a world, which is ring 0 itself.

    Each round writes the new ring alone; from time to time the rings so far become one table, so that plans stay short.
    """
    near, far = ("source", "target") if outward else ("target", "source")
    steps = links.select(F.col(near).alias("world"), F.col(far).alias("next"))
    seen = front = links.sparkSession.createDataFrame([(0, world)], "ring bigint, world string")
    ring = 0
    while limit is None or ring < limit:
        ring += 1
        new = steps.join(front.select("world"), "world", "left_semi").select(F.col("next").alias("world")).distinct().join(seen, "world", "left_anti")
        front = saved(new.select(F.lit(ring).cast("bigint").alias("ring"), "world"), "ring")
        if not front.limit(1).count():
            break
        seen = seen.union(front)
        if ring % 16 == 0:
            seen = saved(seen, "rings")
    return seen


def ring_columns(rings: list[list[str]]) -> list[str]:
    """Rings as lines of left-justified columns, four blanks apart."""
    height = max(map(len, rings), default=0)
    columns = [[*r, *[""] * (height - len(r))] for r in rings]
    widths = [max(map(len, c), default=0) for c in columns]
    return ["    ".join(c[i].ljust(w) for c, w in zip(columns, widths, strict=True)) for i in range(height)]


def paths_to(links: DataFrame, world: str, longest: int | None = None) -> DataFrame:
    """(path): simple paths, as arrays from their first world, that end in a world and cannot be extended backwards.

    Their number grows exponentially with the links; where a limit is given, paths of over ``longest`` worlds raise an error.
    """
    back = links.filter("source <> target").select(F.col("target").alias("head"), "source")
    paths = links.sparkSession.createDataFrame([([world],)], "path array<string>")
    done = None
    for _ in count() if longest is None else range(longest):
        grown = paths.withColumn("head", F.element_at("path", 1)).join(back, "head").filter(~F.array_contains("path", F.col("source")))
        grown = saved(grown.select("path", F.array_prepend("path", F.col("source")).alias("longer")), "paths")
        ended = paths.join(grown.select("path"), "path", "left_anti")
        done = ended if done is None else done.union(ended)
        if not grown.limit(1).count():
            return done
        paths = grown.select(F.col("longer").alias("path"))
    raise ValueError(f"a path to {world!r} has over {longest} worlds")


def paths_via_formulas(lam: DataFrame, world: str, longest: int | None = None) -> DataFrame:
    """(path): paths that end in a world, neighbours sharing a formula; worlds found at one step are not visited below it."""
    own = lam.select("world", "formula").distinct()
    mates = saved(own.select("formula", F.col("world").alias("head")).join(own, "formula").filter("head <> world").select("head", F.col("world").alias("next")).distinct(), "mates")
    paths = lam.sparkSession.createDataFrame([([world], [world])], "path array<string>, visited array<string>")
    done = None
    for _ in count() if longest is None else range(longest):
        found = paths.withColumn("head", F.element_at("path", 1)).join(mates, "head").filter(~F.array_contains("visited", F.col("next")))
        stepped = saved(found.groupBy("path", "visited").agg(F.collect_set("next").alias("new")), "paths")
        ended = paths.join(stepped, "path", "left_anti").select("path")
        done = ended if done is None else done.union(ended)
        if not stepped.limit(1).count():
            return done
        paths = stepped.select(F.explode("new").alias("next"), "path", F.array_union("visited", "new").alias("visited")).select(F.array_prepend("path", F.col("next")).alias("path"), "visited")
    raise ValueError(f"a path to {world!r} has over {longest} worlds")


def inlink_ranks(links: DataFrame, ranks: DataFrame, world: str) -> DataFrame:
    """(source, outlinks, score) of the other worlds that link to a world; outlinks counts all links of a source."""
    to = links.filter((F.col("target") == world) & (F.col("source") != world)).select("source").distinct()
    out = links.join(to, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("outlinks"))
    return out.join(ranks.select(F.col("world").alias("source"), "score"), "source", "left")


def pagerank(links: DataFrame, sweeps: int = 10, start: DataFrame | None = None) -> DataFrame:
    """(world, score) of worlds with links after so many synchronous sweeps from 1.0 each.

    0.15 + 0.85 * the sum of score / outlinks over other worlds that link here; outlinks include a link to itself.
    """
    out = links.groupBy("source").agg(F.count(F.lit(1)).alias("outlinks"))
    flows = links.filter("source <> target").join(out, "source").select("source", "target", "outlinks")
    worlds = links.select(F.col("source").alias("world")).distinct()
    if sweeps > 2:
        flows, worlds = saved(flows, "flows"), saved(worlds, "worlds")
    scores = start or worlds.withColumn("score", F.lit(1.0))
    for i in range(1, sweeps + 1):
        given = flows.join(scores.withColumnRenamed("world", "source"), "source").groupBy(F.col("target").alias("world")).agg(F.sum(F.col("score") / F.col("outlinks")).alias("given"))
        scores = worlds.join(given, "world", "left").select("world", (F.lit(1 - DAMPING) + DAMPING * F.coalesce("given", F.lit(0.0))).alias("score"))
        if i % 5 == 0 and i < sweeps:
            scores = saved(scores, "scores")
    return scores


def hubs_and_authorities(graph: Graph, rounds: int = 20, norm: str = "reference") -> DataFrame:
    """(world, auth, hub) after so many rounds from 1.0 each.

    A round sums hubs of linking worlds to authorities, divides them by their norm, and does the same for hubs over linked
    worlds.  The norm is the root of the sum of roots, or with ``l2`` of squares; a norm of 0 makes scores NaN.
    """
    edges, worlds = saved(graph.links.filter("source <> target").select("source", "target"), "edges"), saved(graph.linked, "worlds")
    scores = worlds.select("world", F.lit(1.0).alias("auth"), F.lit(1.0).alias("hub"))

    def updated(scores: DataFrame, own: str, other: str, at: str, frm: str) -> DataFrame:
        got = edges.join(scores.select(F.col("world").alias(frm), F.col(other).alias("__v")), frm).groupBy(F.col(at).alias("world")).agg(F.sum("__v").alias("__got"))
        new = scores.drop(own).join(got, "world", "left").select("world", other, F.coalesce("__got", F.lit(0.0)).alias(own))
        seen = Observation()
        term = F.sqrt(own) if norm == "reference" else F.col(own) * F.col(own)
        new = saved(new.observe(seen, F.sum(term).alias("total")), "scores")  # the norm is summed while the scores are written
        size = math.sqrt(seen.get["total"] or 0.0)
        return new.select("world", *((F.col(c) / size if size else F.lit(math.nan)).alias(c) if c == own else F.col(c) for c in ("auth", "hub")))

    for _ in range(rounds):
        scores = updated(scores, "auth", "hub", "target", "source")
        scores = updated(scores, "hub", "auth", "source", "target")
    return scores


def hits_partition(graph: Graph, rounds: int = 20) -> DataFrame:
    """(world, part, auth, hub): authorities are the worlds with more authority than hub, the others hubs."""
    found = hubs_and_authorities(graph, rounds)
    more = (F.col("auth") > F.col("hub")) & ~F.isnan("auth")
    return found.select("world", F.when(more, "authority").otherwise("hub").alias("part"), "auth", "hub")


def connected(pairs: DataFrame) -> DataFrame:
    """(world, label): the least world of each connected component of pairs (source, target), taken both ways."""
    edges = saved(pairs.select("source", "target").union(pairs.select("target", "source")).distinct(), "edges")
    labels = nodes(edges).select("world", F.col("world").alias("label"))
    while True:
        low = edges.join(labels.select(F.col("world").alias("target"), "label"), "target").groupBy(F.col("source").alias("world")).agg(F.min("label").alias("low"))
        new = saved(labels.join(low, "world").select("world", "label", F.least("label", "low").alias("next")), "labels")
        hop = new.select(F.col("world").alias("next"), F.col("next").alias("jump"))
        moved = saved(new.join(hop, "next").select("world", "label", F.least("next", "jump").alias("next")), "labels")
        labels = moved.select("world", F.col("next").alias("label"))
        if not moved.filter("label <> next").limit(1).count():
            return labels
