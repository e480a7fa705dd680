"""Truth, frames and scores against set-based definitions on small models."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from modalgraph.functions.formula import And, Box, Diamond, Imp, Not, Or, Var, parse
from modalgraph.model import Graph
from modalgraph.operators import cluster, frames, lookup, modal, partition, rough, schemes, tfidf, traverse

LINKS = {("a", "b"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "d"), ("x", "a")}
LABELS = {"a": {"p": 1, "q": 2}, "b": {"p": 3}, "c": {"q": 1, "r": 1}, "alone": {"p": 1, "r": 4}}
WORLDS = sorted({w for e in LINKS for w in e})


def frame(spark, rows, schema):
    return spark.createDataFrame(sorted(rows), schema)


def graph(spark, links=LINKS, labels=LABELS):
    return Graph(frame(spark, links, "source string, target string"), frame(spark, [(w, f, n) for w, fs in labels.items() for f, n in fs.items()], "world string, formula string, frmcount bigint"))


def holds(f, w, links=LINKS, labels=LABELS):
    if isinstance(f, Var):
        return f.name in labels.get(w, {})
    if isinstance(f, Not):
        return not holds(f.body, w, links, labels)
    if isinstance(f, And):
        return holds(f.left, w, links, labels) and holds(f.right, w, links, labels)
    if isinstance(f, Or):
        return holds(f.left, w, links, labels) or holds(f.right, w, links, labels)
    if isinstance(f, Imp):
        return not holds(f.left, w, links, labels) or holds(f.right, w, links, labels)
    near = [t for s, t in links if s == w]
    return (all if isinstance(f, Box) else any)(holds(f.body, t, links, labels) for t in near)


ATOM = st.builds(Var, st.sampled_from("pqr"))
FORMULA = st.recursive(ATOM, lambda f: st.one_of(st.builds(Not, f), st.builds(Box, f), st.builds(Diamond, f), *(st.builds(k, f, f) for k in (And, Or, Imp))), max_leaves=5)


@given(st.lists(FORMULA, min_size=6, max_size=6))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_truth_everywhere(spark, formulas):
    g = graph(spark)
    got = {r["world"]: [r[f"f{i}"] for i in range(len(formulas))] for r in modal.truths(g, formulas).collect()}
    assert set(got) == set(WORLDS) | set(LABELS)
    for w, values in got.items():
        assert values == [holds(f, w) for f in formulas], w


def test_universes(spark, rows):
    g, f = graph(spark), parse("(Not (Var p))")
    assert rows(modal.satisfying(g, f)) == [("c",)]
    assert rows(modal.satisfying_in_frame(g, f)) == [("c",), ("d",), ("x",)]
    assert modal.true_in(g, parse("(And ([] (Var p)) (Not (<> (Var p))))"), ["nowhere"]).head()[0]
    assert not modal.true_in(g, parse("(Var p)"), ["a", "c"]).head()[0]
    assert modal.universally_true(g, parse("(Or (Var p) (Not (Var p)))")).head()[0]


def test_nested_atoms_are_renamed_below_modal_operators_only(spark, rows):
    found = modal.truths(graph(spark), [parse("(And (Var p) (<> (Var P)))")], nested=str.lower).filter("f0").select("world")
    assert rows(found) == [("a",), ("b",)]


def strict_frames(links):
    out = set()
    for w in {x for e in links for x in e}:
        own = {(s, t) for s, t in links if s == w and t != w}
        near = {t for _, t in own}
        steps = {(s, t) for s, t in links if s in near and t != w and s != t}
        if not {t for _, t in steps} <= near:
            continue
        r = own | steps
        bad = set()
        for v in {x for e in r for x in e}:
            direct = {t for s, t in r if s == v and t != v}
            if not {t for s, t in r if s in direct and t != v} <= direct:
                bad.add(v)
        r = {e for e in r if not set(e) & bad}
        if len({x for e in r for x in e}) > 2 and any((a, d) in r for a, b in r for c, d in r if b == c):
            out.add(frozenset(r))
    return out


@given(st.sets(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde")), min_size=3, max_size=16))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_transitive_frames(spark, links):
    found = {}
    for r in frames.transitive_subframes(frame(spark, links, "source string, target string")).collect():
        found.setdefault(r["frame"], set()).add((r["source"], r["target"]))
    assert {frozenset(e) for e in found.values()} == strict_frames(links)
    assert len(found) == len(strict_frames(links))


def test_axioms_hold_on_their_frames(spark):
    order = {(a, b) for a in "abc" for b in "abc" if a <= b}
    g = graph(spark, order)
    assert frames.axiom_holds(g, "T", "p").head()[0]
    assert frames.axiom_holds(g, "4", "p").head()[0]
    assert frames.axiom_holds(g, "K", "p", "q").head()[0]
    mutual = graph(spark, {("a", "b"), ("b", "a")})
    assert frames.axiom_holds(mutual, "B", "p").head()[0]
    assert not frames.axiom_holds(graph(spark, {("a", "c")}), "T", "p").head()[0]


def test_symmetric_and_reflexive_parts(spark, rows):
    links = frame(spark, {("a", "a"), ("b", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}, "source string, target string")
    assert rows(frames.symmetric(links)) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert rows(frames.reflexive_symmetric(links)) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]


def test_empty_lists(spark, rows):
    g = graph(spark)
    assert rows(lookup.subset_keys(g.lam, "world", "formula", [])) == []
    assert rows(lookup.touching_keys(g.links, "source", "target", [])) == []
    assert len(rows(lookup.without_worlds(g.lam, []))) == 4
    assert rows(rough.of_items(g.lam, "world", "formula", [])) == []


def test_rings_partition_what_is_reached(spark, rows):
    g = graph(spark)
    assert rows(traverse.link_rings(g.links, "x")) == [(0, "x"), (1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(traverse.link_rings(g.links, "a", outward=False)) == [(0, "a"), (1, "b"), (1, "x")]
    assert rows(traverse.link_rings(g.links, "nowhere")) == [(0, "nowhere")]
    assert traverse.ring_columns([["a"], ["bb", "c"]]) == ["a    bb", "     c "]


def test_paths_are_simple_and_maximal(spark, rows):
    g = graph(spark)
    assert rows(traverse.paths_to(g.links, "d")) == [(["x", "a", "b", "c", "d"],)]
    with pytest.raises(ValueError, match="over 2"):
        traverse.paths_to(g.links, "d", longest=2)
    assert rows(traverse.paths_via_formulas(g.lam, "b")) == [(["c", "a", "b"],), (["c", "alone", "b"],)]


def test_pagerank_reaches_its_fixpoint(spark):
    g = graph(spark)
    got = {r["world"]: r["score"] for r in traverse.pagerank(g.links, 60).collect()}
    out = {w: sum(s == w for s, _ in LINKS) for w in WORLDS}
    assert set(got) == {s for s, _ in LINKS}
    for w, score in got.items():
        assert math.isclose(score, 0.15 + 0.85 * sum(got[s] / out[s] for s, t in LINKS if t == w and s != w), abs_tol=1e-6)


def test_hits_without_links_is_nan(spark):
    g = graph(spark, {("a", "a")})
    found = traverse.hits_partition(g, 2).collect()
    assert [r["part"] for r in found] == ["hub"]
    assert math.isnan(found[0]["auth"])


def test_tfidf_and_cuts(spark, rows):
    g = graph(spark)
    got = {(r["world"], r["formula"]): r["tfidf"] for r in tfidf.scored(g.lam).collect()}
    assert math.isclose(got["alone", "r"], 4 * math.log10(4 / 2))
    assert math.isclose(tfidf.score_of(g.lam, "alone", "r").head()[0], got["alone", "r"])
    assert tfidf.score_of(g.lam, "a", "never").head()[0] == 0
    many = spark.createDataFrame([("w", f"f{i:02}", float(-i)) for i in range(25)], "world string, formula string, tfidf double")
    # a tenth of 25 is 2.5, which goes to the even 2; a tenth of the 23 left is 2.3
    assert len(rows(tfidf.cut_percent(many, 10))) == 21
    assert len(rows(tfidf.top_percent(many, 90))) == 23


def test_rough_bounds(spark, rows):
    g = graph(spark)
    assert rows(rough.of_items(g.lam, "world", "formula", ["p", "q"])) == [("a", True, True), ("alone", False, True), ("b", True, True), ("c", False, True)]
    assert rows(rough.of_neighbour(g.lam, "world", "formula", "a")) == rows(rough.of_items(g.lam, "world", "formula", ["p", "q"]))
    assert rows(rough.boundary(rough.of_items(g.lam, "world", "formula", ["p", "q"]))) == [("alone",), ("c",)]


@pytest.mark.parametrize("name", [f"lambda_{a}{b}{n}" for a in ("anded", "ored") for b in ("", "_diamonded", "_boxed") for n in ("", "_negated")])
def test_schemes_are_their_formulas(spark, rows, name):
    def formula(v):
        kind = And if "anded" in name else Or
        f = None
        for t in sorted(LABELS[v]):
            f = Var(t) if f is None else kind(f, Var(t))
        f = Diamond(f) if "diamonded" in name else Box(f) if "boxed" in name else f
        return Not(f) if "negated" in name else f

    want = sorted((v, w) for v in LABELS for w in WORLDS if holds(formula(v), w))
    assert rows(schemes.scheme(graph(spark), name)) == want


def test_partitions(spark, rows):
    g = graph(spark)
    assert rows(partition.dead_ends(g).filter("dead_end"), "world") == [("d",)]
    one, none = spark.createDataFrame([("a",), ("b",)], "world string"), spark.createDataFrame([], "world string")
    assert math.isnan(partition.interrelation(g.links, one, none).head()[0])
    assert partition.cliqueness(g.links, none).head()[0] is None
    assert partition.cliqueness(g.links, one).head()[0] == 1.0
    assert partition.average_links(g.links, one).head()[0] == 1.0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_cluster_statistics(spark):
    clusters = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "alone"), (2, "d"), (2, "x")], "cluster int, world string")
    g = graph(spark)
    got = {r["cluster"]: r for r in cluster.statistics(g, clusters).collect()}
    sets = {w: set(LABELS.get(w, {})) for w in "abcdx"}
    pairs = [(u, v) for u in "abc" for v in "abc" if u < v]
    assert math.isclose(got[0]["sim"], sum(jaccard(sets[u], sets[v]) for u, v in pairs) / 3)
    assert got[1]["sim"] is None and got[1]["cliqueness"] == 1.0
    assert got[2]["sim"] == 1.0
    assert got[0]["cliqueness"] == 3 / 6


def test_k_means_and_single_link(spark, rows):
    worlds = spark.createDataFrame([(w,) for w in "abcd"], "world string")
    places = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 2)], "world string, dim int")
    clusters, centroids = cluster.k_means(worlds, places, [[True, True, False], [False, False, True]])
    assert rows(clusters) == [(0, "a"), (0, "b"), (1, "c"), (1, "d")]
    assert {(r["cluster"], r["dim"]) for r in centroids.collect()} == {(0, None), (0, 0), (0, 1), (1, None), (1, 2)}
    kept = cluster.k_means(worlds, places, [[False] * 3] * 2, 1)
    assert rows(kept[0]) == [(0, w) for w in "abcd"]
    assert {(r["cluster"], r["dim"]) for r in kept[1].collect()} == {(0, None), (0, 0), (1, None)}  # an empty cluster keeps its centroid
    levels = rows(cluster.single_link_edges(worlds, places), "level", "source", "target")
    assert [x for x in levels if x[0] == 1] == [(1, "a", "b"), (1, "b", "d"), (1, "c", "d")]
    assert rows(cluster.single_link_hierarchy(worlds, places)) == [(1, "a", w) for w in "abcd"]


def test_dynamic_k_means_ends_and_keeps_all_worlds(spark, rows):
    g = graph(spark)
    formulas = [Var(t) for t in "pqr"]
    places = cluster.positions(g, formulas)
    clusters, centroids = cluster.dynamic_k_means(g, g.linked, places, [[True, False, False], [False, True, True], [False, False, False]])
    found = rows(clusters)
    assert sorted(w for _, w in found) == WORLDS
    assert sorted({c for c, _ in found}) == sorted({r["cluster"] for r in centroids.collect()}) == list(range(len({c for c, _ in found})))


def test_plans_grow_with_the_formula_and_not_with_its_depth(spark):
    graph = Graph(spark.createDataFrame([("a", "b")], "source string, target string"), spark.createDataFrame([("b", "x", 1)], "world string, formula string, frmcount bigint"))

    def scans(depth):
        text = "(Var x)"
        for i in range(depth):
            text = f"({'[]' if i % 2 else '<>'} (And (Var x) {text}))"
        plan = modal.truths(graph, [parse(text)])._jdf.queryExecution().analyzed().toString()
        return plan.count("LogicalRDD") + plan.count("LocalRelation")

    found = [scans(d) for d in (1, 2, 5, 10)]
    assert found[3] - found[2] == 5 * (found[1] - found[0]) <= 10


def test_tables_of_queries_go_on_request(spark):
    from modalgraph.sources import shared

    folder = shared.work_folder(spark)
    assert spark.sparkContext.applicationId in folder
    other = shared.shared_folder(spark) + "/kept"
    frame(spark, {("a", 1)}, "x string, n int").write.mode("overwrite").parquet(other)
    table = shared.saved(frame(spark, {("a", 1)}, "x string, n int"))
    assert table.count() == 1
    shared.release(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert spark.read.parquet(other).count() == 1 and shared.saved(frame(spark, {("b", 2)}, "x string, n int")).count() == 1


def test_worlds_outside_a_frame_are_an_error(spark):
    g = graph(spark)
    assert modal.true_in_frame(g, parse("(<> (Var p))"), ["a", "b"]).head()["truth"]
    with pytest.raises(ValueError, match="alone"):
        modal.true_in_frame(g, parse("(Var p)"), ["a", "alone"])
