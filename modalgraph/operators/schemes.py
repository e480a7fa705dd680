"""Formula schemes: one formula for each world, and where they are true, as pairs (formula_of, world).

No formula is built: a disjunction of a world's formulas is true where one of them holds, which is a join on formulas; a
conjunction is true where as many hold as the world has; a diamond joins links, a box aggregates over successors.  Only a
negation needs all pairs, as all but few of them are its result.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import Diamond, Formula, Not, Or, Var
from ..model import Graph
from .tfidf import cut_percent, top_percent

#: True in worlds without links, reflexive ones included.
DEAD_END: Formula = Not(Diamond(Or(Var("foo"), Not(Var("foo")))))
PAIR = ["formula_of", "world"]


def _chosen(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("world").alias("formula_of"), "formula").distinct()


def any_of(graph: Graph, terms: DataFrame) -> DataFrame:
    """Pairs of which the world has one of the terms (world, formula) of the other."""
    return _chosen(terms).join(graph.lam.select("world", "formula"), "formula").select(PAIR).distinct()


def all_of(graph: Graph, terms: DataFrame) -> DataFrame:
    chosen = _chosen(terms)
    need = chosen.groupBy("formula_of").agg(F.count(F.lit(1)).alias("need"))
    held = chosen.join(graph.lam.select("world", "formula").distinct(), "formula").groupBy(PAIR).agg(F.count(F.lit(1)).alias("held"))
    return held.join(need, "formula_of").filter("held = need").select(PAIR)


def ahead(graph: Graph) -> Graph:
    """The graph in which worlds have the formulas of the worlds they link to: a disjunction there is the diamond of one here.

    A world has a formula once, however many of its successors share it, before pairs are made.
    """
    reached = graph.lam.select(F.col("world").alias("target"), "formula").join(graph.links, "target").select(F.col("source").alias("world"), "formula").distinct()
    return replace(graph, lam=reached)


def within(pairs: DataFrame, worlds: DataFrame) -> DataFrame:
    return pairs.join(worlds, "world", "left_semi").select(PAIR)


def diamond(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Pairs whose world links to a world of a pair."""
    return pairs.select("formula_of", F.col("world").alias("target")).join(graph.links, "target").select("formula_of", F.col("source").alias("world")).distinct()


def negated(pairs: DataFrame, formulas: DataFrame, worlds: DataFrame) -> DataFrame:
    """All pairs of ``formulas`` (formula_of) and worlds but these: the result itself has this many rows."""
    return formulas.crossJoin(worlds).join(pairs, PAIR, "left_anti").select(PAIR)


def boxed(graph: Graph, pairs: DataFrame, formulas: DataFrame, worlds: DataFrame) -> DataFrame:
    """Pairs all of whose world's successors are in pairs; worlds without links are in a pair with every formula."""
    degree = graph.links.groupBy(F.col("source").alias("world")).agg(F.count(F.lit(1)).alias("degree"))
    reached = pairs.select("formula_of", F.col("world").alias("target")).join(graph.links, "target").groupBy("formula_of", F.col("source").alias("world")).agg(F.count(F.lit(1)).alias("reached"))
    full = reached.join(degree, "world").filter("reached = degree").select(PAIR)
    ends = worlds.join(degree, "world", "left_anti").select("world")
    return full.union(formulas.crossJoin(ends).select(PAIR))  # each of these pairs is a result


def scheme(graph: Graph, name: str, scores: DataFrame | None = None, percent: int = 0) -> DataFrame:
    """(formula_of, world): where each world's formula of a scheme is true, among the graph's linked worlds.

    ``lambda_anded`` and ``lambda_ored``, with ``_diamonded`` or ``_boxed`` and ``_negated`` appended, are over all formulas of
    a world; ``tfidf_cut_ored``, ``tfidf_top_ored``, ``tfidf_top_ored_diamonded`` and ``similar_successor`` over some by score.
    """
    worlds = graph.linked
    if name.startswith("tfidf") or name == "similar_successor":
        if scores is None:
            raise ValueError(f"{name} needs scores (world, formula, tfidf)")
        terms = cut_percent(scores, percent) if name == "tfidf_cut_ored" else top_percent(scores, percent)
        if name == "similar_successor":
            terms = terms.join(worlds, "world", "left_semi")
            near = any_of(ahead(graph), terms)
            return within(all_of(graph, terms).join(near, PAIR, "left_semi"), worlds)
        return within(any_of(ahead(graph) if name.endswith("_diamonded") else graph, terms), worlds)
    parts = name.split("_")
    if parts[0] != "lambda" or parts[1] not in ("anded", "ored") or set(parts[2:]) - {"diamonded", "boxed", "negated"}:
        raise ValueError(f"no scheme {name!r}")
    formulas = graph.lam.select(F.col("world").alias("formula_of")).distinct()
    if parts[1] == "anded":
        pairs = all_of(graph, graph.lam)
        pairs = diamond(graph, pairs) if "diamonded" in parts else pairs
    else:
        pairs = any_of(ahead(graph) if "diamonded" in parts else graph, graph.lam)
    if "boxed" in parts:
        pairs = boxed(graph, pairs, formulas, worlds)
    return negated(pairs, formulas, worlds) if "negated" in parts else within(pairs, worlds)
