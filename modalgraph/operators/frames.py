"""Parts of a frame with properties of its relation: reflexive, symmetric, transitive, and their combinations.

Transitivity is the strict one: x to y and y to z demand x to z for three different worlds.  A set of frames is one table
(frame, source, target), a frame being named by the least world it was found from; frames with equal links are one frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..sources.shared import saved
from .modal import And, Box, Diamond, Formula, Imp, Var, universally_true  # noqa: F401

EDGE = ["source", "target"]


def _semi(edges: DataFrame, worlds: DataFrame, how: str = "left_semi") -> DataFrame:
    """Edges with both ends among ``worlds`` (world), or with left_anti with neither."""
    for end in EDGE:
        edges = edges.join(worlds.withColumnRenamed("world", end), [c for c in ("frame", end) if c in worlds.columns or c == end], how)
    return edges


def drop_links_with(links: DataFrame, worlds: DataFrame) -> DataFrame:
    """Links that touch none of the worlds; with a frame column, each frame's own worlds."""
    return _semi(links, worlds, "left_anti").select(links.columns)


def reflexive(links: DataFrame) -> DataFrame:
    return links.filter("source = target").select(EDGE)


def symmetric(links: DataFrame) -> DataFrame:
    """Links between two worlds that link back."""
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return links.filter("source <> target").join(back, EDGE, "left_semi").select(EDGE)


def _framed(links: DataFrame) -> DataFrame:
    return links.select(F.lit("").alias("frame"), *EDGE)


def _hops(edges: DataFrame) -> DataFrame:
    """(frame, world, target) of two steps within a frame, the first to another world."""
    one = edges.filter("source <> target").select("frame", F.col("source").alias("world"), F.col("target").alias("source"))
    return one.join(edges, ["frame", "source"]).filter("world <> target").select("frame", "world", "target")


def violations(edges: DataFrame) -> DataFrame:
    """(frame, world): worlds that reach in two steps another world that they do not reach in one."""
    direct = edges.select("frame", F.col("source").alias("world"), "target")
    return _hops(edges).join(direct, ["frame", "world", "target"], "left_anti").select("frame", "world").distinct()


def transitive_violations(links: DataFrame) -> DataFrame:
    return violations(_framed(links)).select("world")


def without_violations(links: DataFrame) -> DataFrame:
    """Links that touch no violating world; violations are those of all links, in one pass."""
    return drop_links_with(links, transitive_violations(links)).select(EDGE)


def having_transitive(edges: DataFrame) -> DataFrame:
    """(frame): frames in which some world reaches a world both in one and in two steps."""
    one = edges.select("frame", F.col("source").alias("world"), F.col("target").alias("source"))
    two = one.join(edges, ["frame", "source"]).select("frame", "world", "target")
    return two.join(edges.select("frame", F.col("source").alias("world"), "target"), ["frame", "world", "target"], "left_semi").select("frame").distinct()


def contains_transitive(links: DataFrame) -> DataFrame:
    """One row: whether there is such a world."""
    return having_transitive(_framed(links)).agg((F.count(F.lit(1)) > 0).alias("truth"))


def different(frames: DataFrame) -> DataFrame:
    """One frame of each set of equal frames; equality is that of the counts and two hashes of the links."""
    marks = frames.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*EDGE)).alias("h1"), F.sum(F.hash("target", "source").cast("long")).alias("h2"))
    first = marks.groupBy("n", "h1", "h2").agg(F.min("frame").alias("frame"))
    return frames.join(first, "frame", "left_semi").select("frame", *EDGE)


def transitive_subframes(links: DataFrame) -> DataFrame:
    """(frame, source, target): for each world its links and its targets' links, where these stay among its targets."""
    links = links.select(EDGE)
    own = links.filter("source <> target").select(F.col("source").alias("frame"), *EDGE)
    steps = own.select("frame", F.col("target").alias("source")).join(links, "source").filter("target <> frame and source <> target").select("frame", *EDGE)
    astray = steps.join(own.select("frame", "target"), ["frame", "target"], "left_anti").select("frame").distinct()
    edges = saved(own.union(steps).distinct().join(astray, "frame", "left_anti"), "frames")
    edges = saved(drop_links_with(edges, violations(edges)).select("frame", *EDGE), "frames")
    wide = edges.select("frame", F.explode(F.array(*EDGE)).alias("world")).groupBy("frame").agg(F.countDistinct("world").alias("n")).filter("n > 2").select("frame")
    return different(saved(edges.join(having_transitive(edges), "frame", "left_semi").join(wide, "frame", "left_semi").select("frame", *EDGE), "frames"))


def _loops(edges: DataFrame) -> DataFrame:
    keys = [c for c in edges.columns if c not in EDGE]
    return edges.select(*keys, F.explode(F.array(*EDGE)).alias("source")).distinct().select(*keys, "source", F.col("source").alias("target"))


def reflexive_worlds(links: DataFrame) -> DataFrame:
    return links.filter("source = target").select(F.col("source").alias("world"))


def reflexive_symmetric(links: DataFrame) -> DataFrame:
    """Mutual links whose ends are both reflexive, and the loops of those ends."""
    mutual = _semi(symmetric(links), reflexive_worlds(links)).select(EDGE)
    return mutual.union(_loops(mutual)).distinct()


def _with_loops(edges: DataFrame) -> DataFrame:
    kept = saved(edges.join(having_transitive(edges), "frame", "left_semi").select("frame", *EDGE), "frames")
    return different(saved(kept.union(_loops(kept)).distinct(), "frames"))


def reflexive_transitive(links: DataFrame) -> DataFrame:
    """Transitive frames cut down to reflexive worlds, where still transitive, and the loops of their worlds."""
    return _with_loops(_semi(transitive_subframes(links), reflexive_worlds(links)).select("frame", *EDGE))


def symmetric_transitive(links: DataFrame) -> DataFrame:
    """Transitive frames without the targets of one-way links, where still transitive, made symmetric."""
    frames = transitive_subframes(links)
    back = symmetric(links).select(F.col("target").alias("source"), F.col("source").alias("target"))
    one_way = frames.join(back, EDGE, "left_anti").select("frame", F.col("target").alias("world")).distinct()
    kept = saved(drop_links_with(frames, one_way).select("frame", *EDGE), "frames")
    kept = kept.join(having_transitive(kept), "frame", "left_semi").select("frame", *EDGE)
    return different(saved(kept.union(kept.select("frame", F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "frames"))


def reflexive_symmetric_transitive(links: DataFrame) -> DataFrame:
    return _with_loops(_semi(symmetric_transitive(links), reflexive_worlds(links)).select("frame", *EDGE))


#: Axiom schemes by name; K takes two formulas.
def axiom(name: str, p: Formula, q: Formula | None = None) -> Formula:
    forms = {
        "T": lambda: Imp(p, Diamond(p)),
        "D": lambda: Imp(Box(p), Diamond(p)),
        "B": lambda: Imp(p, Box(Diamond(p))),
        "4": lambda: Imp(Diamond(Diamond(p)), Diamond(p)),
        "5": lambda: Imp(Diamond(p), Box(Diamond(p))),
        "K": lambda: Imp(Box(Imp(p, q)), Imp(Box(p), Box(q))),
    }
    return forms[name]()


def axiom_holds(graph: Graph, name: str, p: str, q: str | None = None) -> DataFrame:
    """One row: whether an axiom is true in all worlds of the frame, for the formulas as they are."""
    return universally_true(graph, axiom(name, Var(p), Var(q) if q is not None else None), graph.linked)
