"""Queries on formulas, axioms and rough sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formula import And, Box, Diamond, Formula, Imp, Not, Or, Var, parse
from ..functions.terms import soundex_code
from ..model import Graph, nodes
from ..operators import frames, modal, rough
from .graph_queries import LISTED, REFL_TRANS, SOME, TERMS, TERMS_SQL, W
from .registry import add

P, Q = "brand#8", "promo"


def truth_sql(f: Formula, world: str, links: str, lam: str, depth: int = 0) -> str:
    """The truth of a formula at a world expression, by correlated subqueries."""
    if isinstance(f, Var):
        return f"EXISTS (SELECT 1 FROM {lam} v{depth} WHERE v{depth}.world = {world} AND v{depth}.formula = '{f.name}')"
    at = lambda p, w=world, d=depth: truth_sql(p, w, links, lam, d + 1)
    if isinstance(f, Not):
        return f"(NOT {at(f.body)})"
    if isinstance(f, And):
        return f"({at(f.left)} AND {at(f.right)})"
    if isinstance(f, Or):
        return f"({at(f.left)} OR {at(f.right)})"
    if isinstance(f, Imp):
        return f"((NOT {at(f.left)}) OR {at(f.right)})"
    body = at(f.body, f"k{depth}.target")
    if isinstance(f, Box):
        return f"(NOT EXISTS (SELECT 1 FROM {links} k{depth} WHERE k{depth}.source = {world} AND NOT {body}))"
    return f"(EXISTS (SELECT 1 FROM {links} k{depth} WHERE k{depth}.source = {world} AND {body}))"


FORMULAS = {
    "var": f"(Var {P})",
    "not": f"(Not (Var {P}))",
    "and": f"(And (Var {P}) (Not (Var {Q})))",
    "or": f"(Or (Var {P}) (Var {Q}))",
    "imp": f"(Imp (Var {P}) (Var {Q}))",
    "box": f"([] (Not (Var {P})))",
    "diamond": f"(<> (Var {P}))",
    "diamond_or": "(<> (Or (Var brand#25) (Var promo)))",
    "box_or": "([] (Or (Var medium) (Or (Var large) (Var standard))))",
    "nested": f"(And ([] (<> (Var {P}))) (Imp (<> (Var {Q})) (Not ([] (Var brand#25)))))",
}
#: The universes of the three families: labelled worlds, worlds of a frame, worlds of a reduced model.
LABELLED = "SELECT DISTINCT world FROM l1"
LINKED = "SELECT source AS world FROM {g} UNION SELECT target FROM {g}"

for name, text in FORMULAS.items():
    f = parse(text)
    modal_only = any(x in text for x in ("[]", "<>"))
    add(f"pml_sat_{name}", lambda d, f=f: modal.satisfying(d.graph("g1", "l1"), f), "g1 l1", f", u AS ({LABELLED}) SELECT world FROM u WHERE {truth_sql(f, 'u.world', 'g1', 'l1')}")
    add(f"fsat_{name}", lambda d, f=f: modal.satisfying_in_frame(d.graph("g2", "l1"), f), "g2 l1", f", u AS ({LINKED.format(g='g2')}) SELECT world FROM u WHERE {truth_sql(f, 'u.world', 'g2', 'l1')}")
    add(
        f"msat_{name}",
        lambda d, f=f: modal.satisfying_in_frame(d.graph("g1", "l1").reduced(d.names(*SOME)), f),
        "g1 l1",
        f", rg AS (SELECT * FROM g1 WHERE source IN ({LISTED}) AND target IN ({LISTED})), rl AS (SELECT * FROM l1 WHERE world IN ({LISTED})), u AS (SELECT unnest([{LISTED}]) AS world) SELECT world FROM u WHERE {truth_sql(f, 'u.world', 'rg', 'rl')}",
    )
    if not modal_only:
        add(f"pl_sat_{name}", lambda d, f=f: modal.satisfying(Graph(d.spark.createDataFrame([], "source string, target string"), d.kept("l1")), f), "l1", f", u AS ({LABELLED}) SELECT world FROM u WHERE {truth_sql(f, 'u.world', 'l1', 'l1')}")

_nested = parse(FORMULAS["nested"])
add("true_in_world", lambda d: modal.true_in(d.graph("g1", "l1"), _nested, [W]), "g1 l1", f"SELECT {truth_sql(_nested, repr(W), 'g1', 'l1')} AS truth")
add("true_in_worlds", lambda d: modal.true_in(d.graph("g1", "l1"), parse(FORMULAS["diamond_or"]), SOME), "g1 l1", f", u AS (SELECT unnest([{LISTED}]) AS world) SELECT bool_and({truth_sql(parse(FORMULAS['diamond_or']), 'u.world', 'g1', 'l1')}) AS truth FROM u")
_valid = parse(f"(Or (Var {P}) (Not (Var {P})))")
add("universally_true", lambda d: modal.universally_true(d.graph("g1", "l1"), _valid), "l1", f", u AS ({LABELLED}) SELECT bool_and({truth_sql(_valid, 'u.world', 'l1', 'l1')}) AS truth FROM u")
add("universally_true_frame", lambda d: modal.universally_true(g := d.graph("g1", "l1"), parse(FORMULAS["diamond_or"]), g.linked), "g1 l1", f", u AS ({LINKED.format(g='g1')}) SELECT bool_and({truth_sql(parse(FORMULAS['diamond_or']), 'u.world', 'g1', 'l1')}) AS truth FROM u")
for name, every in (("all", True), ("ex", False)):
    add(f"quantor_{name}", lambda d, e=every: modal.quantified(d.rows("l1"), F.col("formula").startswith("brand"), e), "l1", f"SELECT bool_{'and' if every else 'or'}(formula LIKE 'brand%') AS truth FROM l1")
add("fml_as_soundex", lambda d: d.names(*TERMS, column="formula").select("formula", soundex_code(F.col("formula")).alias("code")))

for name in ("T", "D", "B", "4", "5"):
    for g in ("g1", "g2"):
        add(f"axiom_{name.lower()}_{g}", lambda d, n=name, g=g: frames.axiom_holds(d.graph(g, "l1"), n, P), f"{g} l1", f", u AS ({LINKED.format(g=g)}) SELECT bool_and({truth_sql(frames.axiom(name, Var(P)), 'u.world', g, 'l1')}) AS truth FROM u")
add("axiom_k", lambda d: frames.axiom_holds(d.graph("g1", "l1"), "K", P, Q), "g1 l1", f", u AS ({LINKED.format(g='g1')}) SELECT bool_and({truth_sql(frames.axiom('K', Var(P), Var(Q)), 'u.world', 'g1', 'l1')}) AS truth FROM u")
add(
    "axiom_4_refl_trans",
    lambda d: frames.axiom_holds(Graph(frames.reflexive_transitive(d.kept("g2")).filter("frame = 'NATION_0'").select("source", "target"), d.kept("l1")), "4", P),
    "g2 l1",
    f"{REFL_TRANS}, one AS (SELECT source, target FROM rt WHERE frame = 'NATION_0'), u AS ({LINKED.format(g='one')}) SELECT coalesce(bool_and({truth_sql(frames.axiom('4', Var(P)), 'u.world', 'one', 'l1')}), true) AS truth FROM u",
)

# rough sets
KEYS = {"lam": ("l1", "world", "formula"), "inlinks": ("g1", "target", "source"), "outlinks": ("g1", "source", "target")}


def rough_sql(table: str, key: str, item: str, concept: str) -> str:
    low = f"SELECT DISTINCT {key} FROM {table} WHERE {item} IN ({concept}) EXCEPT SELECT {key} FROM {table} WHERE {item} NOT IN ({concept})"
    return f"SELECT DISTINCT {key} AS world, {key} IN ({low}) AS in_lower, true AS in_upper FROM {table} WHERE {item} IN ({concept})"


for name, (table, key, item) in KEYS.items():
    concept = TERMS if name == "lam" else SOME
    add(f"rough_{name}{'_list' if name == 'lam' else ''}", lambda d, t=table, k=key, i=item, c=concept: rough.of_items(d.kept(t), k, i, c), table, rough_sql(table, key, item, TERMS_SQL if name == "lam" else LISTED))
    like = "NATION_3"
    add(f"rough_world_{name}", lambda d, t=table, k=key, i=item: rough.of_neighbour(d.kept(t), k, i, "NATION_3"), table, rough_sql(table, key, item, f"SELECT {item} FROM {table} WHERE {key} = '{like}'"))
add("rough_boundary", lambda d: rough.boundary(rough.of_items(d.rows("l1"), "world", "formula", TERMS)), "l1", f"SELECT world FROM l1 WHERE formula IN ({TERMS_SQL}) INTERSECT SELECT world FROM l1 WHERE formula NOT IN ({TERMS_SQL})")


def bounds_sql(f: Formula) -> tuple[str, str]:
    """(lower, upper) of a propositional formula as sets of worlds."""
    if isinstance(f, Var):
        has = f"SELECT world FROM l1 WHERE formula = '{f.name}'"
        return f"(({has}) EXCEPT (SELECT world FROM l1 WHERE formula <> '{f.name}'))", f"({has})"
    if isinstance(f, Not):
        low, high = bounds_sql(f.body)
        return f"((SELECT world FROM l1) EXCEPT {high})", f"((SELECT world FROM l1) EXCEPT {low})"
    if isinstance(f, Imp):
        return bounds_sql(Or(Not(f.left), f.right))
    (a, b), (c, e) = bounds_sql(f.left), bounds_sql(f.right)
    op = "INTERSECT" if isinstance(f, And) else "UNION"
    return f"({a} {op} {c})", f"({b} {op} {e})"


for name in ("var", "not", "and", "or", "imp"):
    f = parse(FORMULAS[name], modal=False)
    low, high = bounds_sql(f)
    add(f"rough_pl_{name}", lambda d, f=f: rough.of_formula(d.rows("l1"), f), "l1", f"SELECT world, world IN {low} AS in_lower, world IN {high} AS in_upper FROM ({low} UNION {high}) x")

__all__ = ["Diamond", "nodes"]
