"""Rough sets of worlds, as (world, in_lower, in_upper): certainly and possibly within a concept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import And, Formula, Imp, Not, Or, Var


def of_items(pairs: DataFrame, key: str, item: str, concept: Sequence[str]) -> DataFrame:
    """Lower: all items of a key are in the concept (it has some); upper: some are.  Keys in neither are left out."""
    inside = F.col(item).isin(list(concept)) if concept else F.lit(False)
    found = pairs.groupBy(F.col(key).alias("world")).agg(F.bool_and(inside).alias("in_lower"), F.bool_or(inside).alias("in_upper"))
    return found.filter("in_upper")


def of_neighbour(pairs: DataFrame, key: str, item: str, like: str) -> DataFrame:
    """The concept is the set of items that one key has."""
    concept = pairs.filter(F.col(key) == like).select(item, F.lit(True).alias("__in")).distinct()
    inside = F.coalesce("__in", F.lit(False))
    found = pairs.join(concept, item, "left").groupBy(F.col(key).alias("world")).agg(F.bool_and(inside).alias("in_lower"), F.bool_or(inside).alias("in_upper"))
    return found.filter("in_upper")


def of_formula(lam: DataFrame, formula: Formula) -> DataFrame:
    """A propositional formula over concepts of one atom each: complements swap bounds, the others combine them."""
    atoms = list(formula.atoms())
    bounds = lam.groupBy("world").agg(*(f.alias(f"{p}{i}") for i, a in enumerate(atoms) for p, f in (("l", F.bool_and(F.col("formula") == a)), ("u", F.bool_or(F.col("formula") == a)))))

    def pair(f: Formula) -> tuple[Column, Column]:
        if isinstance(f, Var):
            i = atoms.index(f.name)
            return F.col(f"l{i}"), F.col(f"u{i}")
        parts = [pair(p) for p in f.parts]
        if isinstance(f, Not):
            return ~parts[0][1], ~parts[0][0]
        if isinstance(f, Imp):
            return ~parts[0][1] | parts[1][0], ~parts[0][0] | parts[1][1]
        if isinstance(f, And):
            return parts[0][0] & parts[1][0], parts[0][1] & parts[1][1]
        if isinstance(f, Or):
            return parts[0][0] | parts[1][0], parts[0][1] | parts[1][1]
        raise ValueError("rough sets are of propositional formulas")

    low, high = pair(formula)
    return bounds.select("world", low.alias("in_lower"), high.alias("in_upper")).filter("in_lower or in_upper")


def boundary(rough: DataFrame) -> DataFrame:
    return rough.filter("in_upper and not in_lower").select("world")
