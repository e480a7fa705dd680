"""Queries on links and formulas: lookups, frames, rings and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, lookup, traverse
from .registry import add

W, V = "NATION_3", "NATION_7"
SOME = ["NATION_1", "NATION_2", "NATION_3", "NATION_6", "NATION_8", "NATION_11", "NATION_12", "NATION_16", "NATION_22"]
LISTED = ", ".join(f"'{w}'" for w in SOME)
TERMS = ["brand#25", "brand#19", "brand#8", "promo", "small", "medium", "brand#22", "standard", "economy"]
TERMS_SQL = ", ".join(f"'{t}'" for t in TERMS)

add("sources_in_links", lambda d: lookup.sources_in_links(d.rows("g3")), "g3", "SELECT DISTINCT source AS world FROM g3")
add("worlds_in_links", lambda d: lookup.worlds_in_links(d.rows("g3")), "g3", "SELECT source AS world FROM g3 UNION SELECT target FROM g3")
add("targets_of", lambda d: lookup.targets_of(d.rows("g3"), "u5"), "g3", "SELECT target AS world FROM g3 WHERE source = 'u5'")
add("sources_of", lambda d: lookup.sources_of(d.rows("g3"), "u5"), "g3", "SELECT source AS world FROM g3 WHERE target = 'u5'")
add("links_from", lambda d: lookup.links_from(d.rows("g1"), SOME), "g1", f"SELECT source, target FROM g1 WHERE source IN ({LISTED})")
add("links_to_unreflexive", lambda d: lookup.links_to(d.rows("g1"), SOME, reflexive=False), "g1", f"SELECT source, target FROM g1 WHERE target IN ({LISTED}) AND source <> target")
add("out_link_count", lambda d: lookup.out_link_count(d.rows("g3"), "u5"), "g3", "SELECT count(*) AS n FROM g3 WHERE source = 'u5'")
add("insert_links", lambda d: lookup.with_links(d.rows("g1"), d.rows("g2")), "g1 g2", "SELECT source, target FROM g1 UNION SELECT source, target FROM g2")
add("outdegree_dist", lambda d: lookup.degree_distribution(d.rows("g3"), "source"), "g3", "SELECT degree, count(*) AS worlds FROM (SELECT source, count(*) AS degree FROM g3 GROUP BY source) x GROUP BY degree")
add("indegree_dist", lambda d: lookup.degree_distribution(d.rows("g3"), "target"), "g3", "SELECT degree, count(*) AS worlds FROM (SELECT target, count(*) AS degree FROM g3 GROUP BY target) x GROUP BY degree")
add("links_among", lambda d: lookup.links_among(d.rows("g1"), d.names(*SOME)), "g1", f"SELECT source, target FROM g1 WHERE source IN ({LISTED}) AND target IN ({LISTED}) AND source <> target")
add("links_between", lambda d: lookup.links_between(d.rows("g1"), d.names(*SOME[:4]), d.names(*SOME[4:])).agg(lookup.count("n")), "g1", f"SELECT count(*) AS n FROM g1 WHERE (source IN ({', '.join(repr(w) for w in SOME[:4])}) AND target IN ({', '.join(repr(w) for w in SOME[4:])})) OR (target IN ({', '.join(repr(w) for w in SOME[:4])}) AND source IN ({', '.join(repr(w) for w in SOME[4:])}))")
add("unrefl_model", lambda d: d.graph("g1", "l1").unreflexive().links.select("source", "target"), "g1", "SELECT source, target FROM g1 WHERE source <> target")
add("reduce_model", lambda d: d.graph("g1", "l1").reduced(d.names(*SOME)).links, "g1", f"SELECT source, target FROM g1 WHERE source IN ({LISTED}) AND target IN ({LISTED})")
add("reduce_model_lambda", lambda d: d.graph("g1", "l1").reduced(d.names(*SOME)).lam.select("world", "formula"), "l1", f"SELECT world, formula FROM l1 WHERE world IN ({LISTED})")

add("world_formulas", lambda d: lookup.world_formulas(d.rows("l1"), W), "l1", f"SELECT formula FROM l1 WHERE world = '{W}'")
add("world_fml_counts", lambda d: lookup.world_formula_counts(d.rows("l2"), "u5"), "l2", "SELECT formula, CAST(frmcount AS BIGINT) AS frmcount FROM l2 WHERE world = 'u5'")
add("term_frequency", lambda d: lookup.term_frequency(d.rows("l2"), "u5", "click_1"), "l2", "SELECT CAST(coalesce(max(frmcount), 0) AS BIGINT) AS n FROM l2 WHERE world = 'u5' AND formula = 'click_1'")
add("document_frequency", lambda d: lookup.document_frequency(d.rows("l1"), "brand#25"), "l1", "SELECT count(*) AS n FROM l1 WHERE formula = 'brand#25'")
add("world_count", lambda d: lookup.world_count(d.rows("l3")), "l3", "SELECT count(DISTINCT world) AS n FROM l3")
add("worlds_with_formula", lambda d: lookup.worlds_with_formula(d.rows("l1"), "brand#25"), "l1", "SELECT world FROM l1 WHERE formula = 'brand#25'")
add("worlds_in_lambda", lambda d: lookup.worlds_in_lambda(d.rows("l2")), "l2", "SELECT DISTINCT world FROM l2")
add("formulas_in_lambda", lambda d: lookup.formulas_in_lambda(d.rows("l3")), "l3", "SELECT DISTINCT formula FROM l3")
add("worlds_intersecting_lambda", lambda d: lookup.worlds_intersecting(d.rows("l1"), [W, V], W), "l1", f"SELECT DISTINCT world FROM l1 WHERE world NOT IN ('{W}', '{V}') AND formula IN (SELECT formula FROM l1 WHERE world = '{W}')")
add("negate_worlds", lambda d: lookup.without_worlds(d.rows("l1"), SOME), "l1", f"SELECT DISTINCT world FROM l1 WHERE world NOT IN ({LISTED})")
add("negate_no_worlds", lambda d: lookup.without_worlds(d.rows("l1"), []), "l1", "SELECT DISTINCT world FROM l1")
add("lambda_accum", lambda d: lookup.accumulated(d.rows("l3")).withColumn("share", F.round("share", 9)), "l3", "SELECT formula, CAST(sum(frmcount) AS BIGINT) AS total, round(CAST(sum(frmcount) AS DOUBLE) / (SELECT CAST(sum(frmcount) AS DOUBLE) FROM l3), 9) AS share FROM l3 GROUP BY formula")
add("insert_lambda", lambda d: lookup.with_counts(d.rows("l1"), d.rows("l1").filter("formula = 'promo'").select(F.lit(W).alias("world"), "formula", "frmcount").limit(1).withColumn("frmcount", F.lit(3))), "l1", f"SELECT world, formula, CAST(sum(frmcount) AS BIGINT) AS frmcount FROM (SELECT world, formula, frmcount FROM l1 UNION ALL SELECT '{W}', 'promo', 3 WHERE EXISTS (SELECT 1 FROM l1 WHERE formula = 'promo')) x GROUP BY world, formula")
add("update_fml_count", lambda d: lookup.with_replaced_counts(d.rows("l1"), d.spark.createDataFrame([(W, t, 9) for t in TERMS], "world string, formula string, frmcount bigint")), "l1", f"SELECT world, formula, CAST(CASE WHEN world = '{W}' AND formula IN ({TERMS_SQL}) THEN 9 ELSE frmcount END AS BIGINT) AS frmcount FROM l1")
add("delete_lambda_world", lambda d: lookup.without_world(d.rows("l1"), W).select("world", "formula"), "l1", f"SELECT world, formula FROM l1 WHERE world <> '{W}'")
add("fmlset_subset", lambda d: lookup.subset_keys(d.rows("l1"), "world", "formula", TERMS), "l1", f"SELECT DISTINCT world FROM l1 WHERE formula IN ({TERMS_SQL}) EXCEPT SELECT world FROM l1 WHERE formula NOT IN ({TERMS_SQL})")
#: Sets that are wide enough to hold all formulas or neighbours of some worlds.
MANY = [*(f"brand#{i}" for i in range(1, 26) if i not in (12, 16)), "economy", "large", "medium", "promo", "small", "standard"]
HUBS = {"olinks": ["NATION_6", "NATION_7", "NATION_9", "NATION_11"], "ilinks": ["NATION_1", "NATION_4", "NATION_9", "NATION_13", "NATION_17"]}
_quoted = lambda items: ", ".join(f"'{x}'" for x in items)
add("fmlset_subset_many", lambda d: lookup.subset_keys(d.rows("l1"), "world", "formula", MANY), "l1", f"SELECT DISTINCT world FROM l1 WHERE formula IN ({_quoted(MANY)}) EXCEPT SELECT world FROM l1 WHERE formula NOT IN ({_quoted(MANY)})")
add("fmlset_intersect", lambda d: lookup.touching_keys(d.rows("l1"), "world", "formula", TERMS), "l1", f"SELECT DISTINCT world FROM l1 WHERE formula IN ({TERMS_SQL})")
for end, key, item in (("olinks", "source", "target"), ("ilinks", "target", "source")):
    add(f"{end}_subset", lambda d, k=key, i=item: lookup.subset_keys(d.rows("g1"), k, i, SOME), "g1", f"SELECT DISTINCT {key} AS world FROM g1 WHERE {item} IN ({LISTED}) EXCEPT SELECT {key} FROM g1 WHERE {item} NOT IN ({LISTED})")
    add(f"{end}_subset_hubs", lambda d, e=end, k=key, i=item: lookup.subset_keys(d.rows("g1"), k, i, HUBS[e]), "g1", f"SELECT DISTINCT {key} AS world FROM g1 WHERE {item} IN ({_quoted(HUBS[end])}) EXCEPT SELECT {key} FROM g1 WHERE {item} NOT IN ({_quoted(HUBS[end])})")
    add(f"{end}_intersect", lambda d, k=key, i=item: lookup.touching_keys(d.rows("g1"), k, i, SOME), "g1", f"SELECT DISTINCT {key} AS world FROM g1 WHERE {item} IN ({LISTED})")

# frames
add("refl_subframe", lambda d: frames.reflexive(d.rows("g3")), "g3", "SELECT source, target FROM g3 WHERE source = target")
SYM = "SELECT a.source, a.target FROM {g} a WHERE a.source <> a.target AND EXISTS (SELECT 1 FROM {g} b WHERE b.source = a.target AND b.target = a.source)"
add("sym_subframe", lambda d: frames.symmetric(d.kept("g3")), "g3", SYM.format(g="g3"))
add("drop_rels_with", lambda d: frames.drop_links_with(d.rows("g1"), d.names(*SOME[:3])), "g1", f"SELECT source, target FROM g1 WHERE source NOT IN ({', '.join(repr(w) for w in SOME[:3])}) AND target NOT IN ({', '.join(repr(w) for w in SOME[:3])})")
VIOL = "SELECT DISTINCT a.source AS world FROM {g} a JOIN {g} b ON a.target = b.source WHERE a.source <> a.target AND b.target <> a.source AND NOT EXISTS (SELECT 1 FROM {g} c WHERE c.source = a.source AND c.target = b.target)"
add("trans_violations", lambda d: frames.transitive_violations(d.kept("g3")), "g3", VIOL.format(g="g3"))
add("drop_trans_violations", lambda d: frames.without_violations(d.kept("g2").filter("source <> 'NATION_3'").union(d.kept("g1")).distinct()), "g1 g2", f", g AS (SELECT source, target FROM g2 WHERE source <> 'NATION_3' UNION SELECT source, target FROM g1), v AS ({VIOL.format(g='g')}) SELECT source, target FROM g WHERE source NOT IN (SELECT world FROM v) AND target NOT IN (SELECT world FROM v)")
add("contains_trans", lambda d: frames.contains_transitive(d.kept("g1")), "g1", "SELECT count(*) > 0 AS truth FROM g1 a JOIN g1 b ON a.target = b.source JOIN g1 c ON c.source = a.source AND c.target = b.target")
#: Transitive frames as CTEs: own links, second steps, frames without strays, violators, kept links, equal frames named once.
TRANS = """, o AS (SELECT source AS frame, source, target FROM {g} WHERE source <> target),
 s AS (SELECT DISTINCT o.frame, l.source, l.target FROM o JOIN {g} l ON l.source = o.target WHERE l.target <> o.frame AND l.source <> l.target),
 bad AS (SELECT DISTINCT frame FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.frame = s.frame AND o.target = s.target)),
 e0 AS (SELECT * FROM (SELECT * FROM o UNION SELECT * FROM s) x WHERE frame NOT IN (SELECT frame FROM bad)),
 vio AS (SELECT DISTINCT a.frame, a.source AS world FROM e0 a JOIN e0 b ON a.frame = b.frame AND a.target = b.source WHERE a.source <> a.target AND b.target <> a.source
   AND NOT EXISTS (SELECT 1 FROM e0 c WHERE c.frame = a.frame AND c.source = a.source AND c.target = b.target)),
 e1 AS (SELECT * FROM e0 WHERE NOT EXISTS (SELECT 1 FROM vio WHERE vio.frame = e0.frame AND vio.world IN (e0.source, e0.target))),
 good AS (SELECT DISTINCT a.frame FROM e1 a JOIN e1 b ON a.frame = b.frame AND a.target = b.source JOIN e1 c ON c.frame = a.frame AND c.source = a.source AND c.target = b.target),
 wide AS (SELECT frame FROM (SELECT frame, source AS w FROM e1 UNION SELECT frame, target FROM e1) x GROUP BY frame HAVING count(*) > 2),
 e2 AS (SELECT * FROM e1 WHERE frame IN (SELECT frame FROM good) AND frame IN (SELECT frame FROM wide)),
 mark AS (SELECT frame, list_sort(list(source || '>' || target)) AS edges FROM e2 GROUP BY frame),
 t AS (SELECT e2.* FROM e2 WHERE frame IN (SELECT min(frame) FROM mark GROUP BY edges))"""
GOOD = "SELECT DISTINCT a.frame FROM {e} a JOIN {e} b ON a.frame = b.frame AND a.target = b.source JOIN {e} c ON c.frame = a.frame AND c.source = a.source AND c.target = b.target"
FIRST = "SELECT frame, source, target FROM {e} WHERE frame IN (SELECT min(frame) FROM (SELECT frame, list_sort(list(source || '>' || target)) AS edges FROM {e} GROUP BY frame) m GROUP BY edges)"
RW = "(SELECT source FROM {g} WHERE source = target)"
for g in ("g1", "g2", "g3"):
    add(f"trans_subframes_{g}", lambda d, g=g: frames.transitive_subframes(d.kept(g)), g, TRANS.format(g=g) + " SELECT frame, source, target FROM t")
add("refl_sym_subframe", lambda d: frames.reflexive_symmetric(d.kept("g2")), "g2", f", m AS ({SYM.format(g='g2')}), k AS (SELECT * FROM m WHERE source IN {RW.format(g='g2')} AND target IN {RW.format(g='g2')}) SELECT source, target FROM k UNION SELECT source, source FROM k UNION SELECT target, target FROM k")
LOOPED = "SELECT frame, source, target FROM {e} UNION SELECT frame, source, source FROM {e} UNION SELECT frame, target, target FROM {e}"
REFL = ", r0 AS (SELECT * FROM {t} WHERE source IN {rw} AND target IN {rw}), rg AS ({good}), r1 AS (SELECT * FROM r0 WHERE frame IN (SELECT frame FROM rg)), r2 AS ({looped}) {first}"
SYMT = ", m AS ({sym}), ow AS (SELECT DISTINCT frame, target AS world FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = t.target AND m.target = t.source)), s0 AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.frame = t.frame AND ow.world IN (t.source, t.target))), sg AS ({good}), s1 AS (SELECT * FROM s0 WHERE frame IN (SELECT frame FROM sg)), s2 AS (SELECT frame, source, target FROM s1 UNION SELECT frame, target, source FROM s1), st AS ({first})"
add("refl_trans_subframes", lambda d: frames.reflexive_transitive(d.kept("g2")), "g2", TRANS.format(g="g2") + REFL.format(t="t", rw=RW.format(g="g2"), good=GOOD.format(e="r0"), looped=LOOPED.format(e="r1"), first=FIRST.format(e="r2")))
#: Reflexive transitive frames of g2 as a CTE.
REFL_TRANS = TRANS.format(g="g2") + REFL.format(t="t", rw=RW.format(g="g2"), good=GOOD.format(e="r0"), looped=LOOPED.format(e="r1"), first=f", rt AS ({FIRST.format(e='r2')})")
_sym = SYMT.format(sym=SYM.format(g="g2"), good=GOOD.format(e="s0"), first=FIRST.format(e="s2"))
add("sym_trans_subframes", lambda d: frames.symmetric_transitive(d.kept("g2")), "g2", TRANS.format(g="g2") + _sym + " SELECT frame, source, target FROM st")
add("refl_sym_trans_subframes", lambda d: frames.reflexive_symmetric_transitive(d.kept("g2")), "g2", TRANS.format(g="g2") + _sym + REFL.format(t="st", rw=RW.format(g="g2"), good=GOOD.format(e="r0"), looped=LOOPED.format(e="r1"), first=FIRST.format(e="r2")))

# rings and paths
for way, near, far in (("out", "source", "target"), ("in", "target", "source")):
    add(
        f"{way}_link_rings",
        lambda d, w=way: traverse.link_rings(d.kept("g3"), "u1", outward=w == "out"),
        "g3",
        f", r AS (SELECT 'u1' AS world, CAST(0 AS BIGINT) AS ring UNION SELECT g3.{far}, r.ring + 1 FROM r JOIN g3 ON g3.{near} = r.world WHERE r.ring < 12) SELECT min(ring) AS ring, world FROM r GROUP BY world",
    )
PATHS = ", p AS (SELECT '{w}' AS head, ['{w}'] AS path UNION ALL SELECT l.source, list_prepend(l.source, p.path) FROM p JOIN {g} l ON l.target = p.head WHERE NOT list_contains(p.path, l.source)) SELECT array_to_string(path, '>') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM {g} l WHERE l.target = p.head AND NOT list_contains(p.path, l.source))"
add("paths_to", lambda d: traverse.paths_to(d.kept("g2"), "NATION_24").select(F.array_join("path", ">").alias("path")), "g2", PATHS.format(g="g2", w="NATION_24"))
add("paths_to_g1", lambda d: traverse.paths_to(d.kept("g1"), W).select(F.array_join("path", ">").alias("path")), "g1", PATHS.format(g="g1", w=W))
VIA = ", m AS (SELECT DISTINCT a.world AS head, b.world AS nxt FROM l1 a JOIN l1 b ON a.formula = b.formula WHERE a.world <> b.world), p AS (SELECT CAST('{w}' AS VARCHAR) AS head, ['{w}'] AS path, ['{w}'] AS visited UNION ALL SELECT nxt, list_prepend(nxt, path), list_concat(visited, (SELECT list(nxt) FROM m m2 WHERE m2.head = p.head AND NOT list_contains(p.visited, m2.nxt))) FROM p JOIN m ON m.head = p.head WHERE NOT list_contains(p.visited, m.nxt)) SELECT array_to_string(path, '>') AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.head = p.head AND NOT list_contains(p.visited, m.nxt))"
add("paths_to_via_lambda", lambda d: traverse.paths_via_formulas(d.kept("l1"), W).select(F.array_join("path", ">").alias("path")), "l1", VIA.format(w=W))
