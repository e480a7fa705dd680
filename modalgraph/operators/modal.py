"""Truth of formulas in all worlds at once.

A formula becomes one plan: the truth of the atoms right below an operator is one aggregation over the formulas of worlds,
connectives are column expressions, and each modal part is one join of links with the truth of its body.  Truth is defined on all
worlds, linked or labelled; only the answer is restricted to the worlds a question is about.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import And, Box, Diamond, Formula, Imp, Not, Or, Var
from ..model import Graph
from .lookup import holding


def _direct(formula: Formula, kinds: type | tuple[type, ...]) -> dict[Formula, None]:
    """The atoms or modal parts of a formula that are below no modal operator of it, in order, each once."""
    if isinstance(formula, kinds):
        return {formula: None}
    if isinstance(formula, Box | Diamond):
        return {}
    return {f: None for p in formula.parts for f in _direct(p, kinds)}


def truths(graph: Graph, formulas: Sequence[Formula], worlds: DataFrame | None = None, nested: Callable[[str], str] | None = None, held_in: Callable[[Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """(world, f0, f1, ...): the truth of each formula in each of ``worlds`` (all worlds if not given).

    ``nested`` renames atoms below a modal operator, where they are asked for in the form of the target world.  A modal part is
    one aggregation over links, whose targets meet the atoms and modal parts right below it, so the plan grows with the formula.
    ``held_in`` gives the worlds in which atoms hold, (world, atom), where that is more than having the formula of that name.
    """
    held_in = held_in or (lambda atoms: holding(graph.lam, atoms))

    def name(atom: Var, below: bool) -> str:
        return nested(atom.name) if below and nested else atom.name

    def with_parts(rows: DataFrame, key: str, of: Sequence[Formula], below: bool) -> tuple[DataFrame, Callable[[Formula], Column]]:
        """Joins the truth of atoms and modal parts right below some formulas to the worlds in a column, and reads formulas off them."""
        columns: dict[str | Formula, str] = {}
        for atom in {name(a, below): None for f in of for a in _direct(f, Var)}:
            columns[atom] = f"__a{len(columns)}"
        if columns:
            held = held_in(list(columns)).groupBy(F.col("world").alias(key)).agg(*(F.bool_or(F.col("atom") == a).alias(c) for a, c in columns.items()))
            rows = rows.join(held, key, "left")
        for part in {m: None for f in of for m in _direct(f, (Box, Diamond))}:
            columns[part] = f"__m{len(columns)}"
            rows = rows.join(reached(part).select(F.col("world").alias(key), F.col("truth").alias(columns[part])), key, "left")

        def column(f: Formula) -> Column:
            if isinstance(f, Var):
                return F.coalesce(F.col(columns[name(f, below)]), F.lit(False))
            if isinstance(f, Box | Diamond):
                return F.coalesce(F.col(columns[f]), F.lit(isinstance(f, Box)))
            parts = [column(p) for p in f.parts]
            if isinstance(f, Not):
                return ~parts[0]
            if isinstance(f, Imp):
                return ~parts[0] | parts[1]
            return parts[0] & parts[1] if isinstance(f, And) else parts[0] | parts[1]

        return rows, column

    def reached(f: Formula) -> DataFrame:
        """(world, truth) of a modal formula in the worlds that have links; in others a box is true and a diamond is not."""
        rows, column = with_parts(graph.links.select("source", "target"), "target", [f.body], True)
        return rows.groupBy(F.col("source").alias("world")).agg((F.bool_and if isinstance(f, Box) else F.bool_or)(column(f.body)).alias("truth"))

    asked = graph.everywhere if worlds is None else graph.everywhere.join(worlds, "world", "left_semi")
    table, column = with_parts(asked, "world", formulas, False)
    return table.select("world", *(column(f).alias(f"f{i}") for i, f in enumerate(formulas)))


def satisfying(graph: Graph, formula: Formula, worlds: DataFrame | None = None, held_in: Callable[[Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """(world): labelled worlds, or those given, in which a formula is true."""
    return truths(graph, [formula], graph.labelled if worlds is None else worlds, held_in=held_in).filter("f0").select("world")


def satisfying_in_frame(graph: Graph, formula: Formula) -> DataFrame:
    """(world): worlds of the frame in which a formula is true."""
    return satisfying(graph, formula, graph.linked)


def true_in(graph: Graph, formula: Formula, worlds: Sequence[str]) -> DataFrame:
    """One row: whether a formula is true in all of the worlds named; a world that is nowhere has no formulas and no links."""
    spark = graph.lam.sparkSession
    asked = spark.createDataFrame([(w,) for w in worlds], "world string")
    wider = Graph(graph.links, graph.lam, graph.linked.union(asked).distinct())
    return truths(wider, [formula], asked).agg(F.coalesce(F.bool_and("f0"), F.lit(True)).alias("truth"))


def true_in_frame(graph: Graph, formula: Formula, worlds: Sequence[str]) -> DataFrame:
    """One row: whether a formula is true in all of the worlds named, which have to be worlds of the frame."""
    asked = graph.lam.sparkSession.createDataFrame([(w,) for w in worlds], "world string")
    strange = [r["world"] for r in asked.join(graph.linked, "world", "left_anti").orderBy("world").collect()]
    if strange:
        raise ValueError(f"worlds that are not in the frame: {', '.join(strange)}")
    return truths(graph, [formula], asked).agg(F.coalesce(F.bool_and("f0"), F.lit(True)).alias("truth"))


def universally_true(graph: Graph, formula: Formula, worlds: DataFrame | None = None) -> DataFrame:
    """One row: whether a formula is true in all labelled worlds, or in all given."""
    found = truths(graph, [formula], graph.labelled if worlds is None else worlds)
    return found.agg(F.coalesce(F.bool_and("f0"), F.lit(True)).alias("truth"))


def quantified(items: DataFrame, predicate: Column, every: bool) -> DataFrame:
    """One row: whether a predicate holds for every (or some) row."""
    return items.agg(F.coalesce((F.bool_and if every else F.bool_or)(predicate), F.lit(every)).alias("truth"))


__all__ = ["And", "Box", "Diamond", "Formula", "Imp", "Not", "Or", "Var", "quantified", "satisfying", "satisfying_in_frame", "true_in", "true_in_frame", "truths", "universally_true"]
