"""Queries on scores, schemes, partitions and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measure
from ..functions.formula import Var
from ..model import nodes
from ..operators import cluster, partition, schemes, tfidf, traverse
from ..operators.lookup import count
from .graph_queries import LISTED, SOME, TERMS, W
from .registry import add

R = lambda df, *cols, n=6: df.withColumns({c: F.round(c, n) for c in cols})

# tf-idf
SCORED = ", n AS (SELECT count(DISTINCT world) AS n FROM {l}), f AS (SELECT formula, count(*) AS df FROM {l} GROUP BY formula), s AS (SELECT world, formula, frmcount, frmcount * log10(n / CAST(df AS DOUBLE)) AS tfidf FROM {l} JOIN f USING (formula), n)"
RANKED = SCORED + ", r AS (SELECT *, row_number() OVER (PARTITION BY world ORDER BY round(tfidf, 9) DESC, formula) AS rank, count(*) OVER (PARTITION BY world) AS many FROM s)"
scores = lambda d, l: tfidf.scored(d.kept(l)).withColumn("tfidf", F.round("tfidf", 9))  # noqa: E731, E741

add("all_tfidf", lambda d: R(tfidf.scored(d.kept("l3")).select("world", "formula", "tfidf"), "tfidf"), "l3", SCORED.format(l="l3") + " SELECT world, formula, round(tfidf, 6) AS tfidf FROM s")
add("all_top_tfidf", lambda d: R(tfidf.top_n(scores(d, "l3"), 5).select("world", "formula", "tfidf", "rank"), "tfidf"), "l3", RANKED.format(l="l3") + " SELECT world, formula, round(tfidf, 6) AS tfidf, rank FROM r WHERE rank <= 5")
add("tfidf_single", lambda d: R(tfidf.score_of(d.rows("l2"), "u5", "click_1"), "tfidf"), "l2", SCORED.format(l="l2") + " SELECT round(coalesce((SELECT tfidf FROM s WHERE world = 'u5' AND formula = 'click_1'), 0.0), 6) AS tfidf")
add("world_tfidf", lambda d: R(tfidf.of_world(d.rows("l2"), "u5"), "tfidf"), "l2", SCORED.format(l="l2") + " SELECT formula, round(tfidf, 6) AS tfidf FROM s WHERE world = 'u5'")
add("world_top_tfidf", lambda d: tfidf.top_n(scores(d, "l2").filter("world = 'u5'"), 4).select("formula", "rank"), "l2", RANKED.format(l="l2") + " SELECT formula, rank FROM r WHERE world = 'u5' AND rank <= 4")
add("world_top_pct_tfidf", lambda d: tfidf.top_percent(scores(d, "l2").filter("world = 'u5'"), 30).select("formula", "rank"), "l2", RANKED.format(l="l2") + " SELECT formula, rank FROM r WHERE world = 'u5' AND rank <= many - round_even(CAST(many * 0.7 AS DOUBLE), 0)")
add("all_tfidf_stored", lambda d: R(_stored(d).select("world", "formula", "tfidf"), "tfidf"), "l2", SCORED.format(l="l2") + " SELECT world, formula, round(tfidf, 6) AS tfidf FROM s")
add("world_tfidf_stored", lambda d: R(_stored(d).filter("world = 'u5'").select("formula", "tfidf").orderBy(F.col("tfidf").desc_nulls_first()), "tfidf"), "l2", SCORED.format(l="l2") + " SELECT formula, round(tfidf, 6) AS tfidf FROM s WHERE world = 'u5'")
add("tfidf_search", lambda d: R(tfidf.search(d.kept("l3"), "the"), "tfidf"), "l3", SCORED.format(l="l3") + " SELECT world, round(tfidf, 6) AS tfidf FROM s WHERE formula = 'the'")
add(
    "pct_cut",
    lambda d: tfidf.cut_percent(scores(d, "l2"), 15).select("world", "formula", "rank"),
    "l2",
    RANKED.format(l="l2") + ", h AS (SELECT *, round_even(CAST(many * 0.15 AS DOUBLE), 0) AS head FROM r) SELECT world, formula, rank FROM h WHERE rank > head AND rank <= many - round_even(CAST((many - head) * 0.15 AS DOUBLE), 0)",
)


def _stored(d):
    """Scores written to a table and read back, as the store keeps them."""
    from ..sources.shared import saved

    return saved(tfidf.scored(d.rows("l2")), "lambda")


# PageRank and HITS
def pagerank_sql(g: str, sweeps: int) -> str:
    sql = f", w AS (SELECT DISTINCT source AS world FROM {g}), o AS (SELECT source, count(*) AS n FROM {g} GROUP BY source), p0 AS (SELECT world, CAST(1.0 AS DOUBLE) AS score FROM w)"
    for i in range(1, sweeps + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT w.world, 0.15 + 0.85 * coalesce((SELECT sum(p.score / o.n) FROM {g} l JOIN p{i - 1} p ON p.world = l.source JOIN o ON o.source = l.source WHERE l.target = w.world AND l.source <> l.target), 0) AS score FROM w)"
    return sql + f" SELECT world, round(score, 6) AS score FROM p{sweeps}"


add("pagerank_step", lambda d: R(traverse.pagerank(d.kept("g3"), 1), "score"), "g3", pagerank_sql("g3", 1))
add("pagerank_iter_5", lambda d: R(traverse.pagerank(d.kept("g3"), 5), "score"), "g3", pagerank_sql("g3", 5))
add("pagerank_iter_10", lambda d: R(traverse.pagerank(d.kept("g1"), 10), "score"), "g1", pagerank_sql("g1", 10))
add("inlink_outdeg_rank", lambda d: R(traverse.inlink_ranks(d.kept("g3"), traverse.pagerank(d.kept("g3"), 1), "u5"), "score"), "g3", pagerank_sql("g3", 1).replace(" SELECT world, round(score, 6) AS score FROM p1", " SELECT l.source, CAST(o.n AS BIGINT) AS outlinks, round(p.score, 6) AS score FROM g3 l JOIN o ON o.source = l.source LEFT JOIN p1 p ON p.world = l.source WHERE l.target = 'u5' AND l.source <> 'u5'"))


def hits_sql(g: str, rounds: int) -> str:
    sql = f", w AS (SELECT source AS world FROM {g} UNION SELECT target FROM {g}), h0 AS (SELECT world, CAST(1.0 AS DOUBLE) AS auth, CAST(1.0 AS DOUBLE) AS hub FROM w)"
    for i in range(1, rounds + 1):
        sql += f", a{i} AS MATERIALIZED (SELECT w.world, coalesce((SELECT sum(h.hub) FROM {g} l JOIN h{i - 1} h ON h.world = l.source WHERE l.target = w.world AND l.source <> l.target), 0) AS auth FROM w)"
        sql += f", b{i} AS MATERIALIZED (SELECT world, auth / (SELECT sqrt(sum(sqrt(auth))) FROM a{i}) AS auth FROM a{i})"
        sql += f", c{i} AS MATERIALIZED (SELECT w.world, coalesce((SELECT sum(b.auth) FROM {g} l JOIN b{i} b ON b.world = l.target WHERE l.source = w.world AND l.source <> l.target), 0) AS hub FROM w)"
        sql += f", h{i} AS MATERIALIZED (SELECT b.world, b.auth, c.hub / (SELECT sqrt(sum(sqrt(hub))) FROM c{i}) AS hub FROM b{i} b JOIN c{i} c USING (world))"
    return sql + f" SELECT world, round(auth, 6) AS auth, round(hub, 6) AS hub FROM h{rounds}"


add("hits_2", lambda d: R(traverse.hubs_and_authorities(d.graph("g1", "l1"), 2), "auth", "hub"), "g1", hits_sql("g1", 2))
add("hits_3_g3", lambda d: R(traverse.hubs_and_authorities(d.graph("g3", "l2"), 3), "auth", "hub"), "g3", hits_sql("g3", 3))
add("hits_partition", lambda d: traverse.hits_partition(d.graph("g1", "l1")).select("world", "part"), "g1", hits_sql("g1", 20).replace("round(auth, 6) AS auth, round(hub, 6) AS hub", "CASE WHEN auth > hub AND NOT isnan(auth) THEN 'authority' ELSE 'hub' END AS part"))

# schemes on G1 and L1, worlds being those linked
U = "u AS (SELECT source AS world FROM g1 UNION SELECT target FROM g1), k AS (SELECT DISTINCT world AS v FROM l1)"
ANY = "EXISTS (SELECT 1 FROM l1 a JOIN l1 b ON a.formula = b.formula WHERE a.world = k.v AND b.world = {w})"
ALL = "NOT EXISTS (SELECT 1 FROM l1 a WHERE a.world = k.v AND NOT EXISTS (SELECT 1 FROM l1 b WHERE b.world = {w} AND b.formula = a.formula))"
for base, at in (("anded", ALL), ("ored", ANY)):
    here = at.format(w="u.world")
    there = at.format(w="e.target")
    forms = {
        "": here,
        "_negated": f"NOT ({here})",
        "_diamonded": f"EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world AND {there})",
        "_diamonded_negated": f"NOT EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world AND {there})",
        "_boxed": f"NOT EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world AND NOT ({there}))",
        "_boxed_negated": f"EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world AND NOT ({there}))",
    }
    for suffix, condition in forms.items():
        add(f"scheme_lambda_{base}{suffix}", lambda d, n=f"lambda_{base}{suffix}": schemes.scheme(d.graph("g1", "l1"), n), "g1 l1", f", {U} SELECT k.v AS formula_of, u.world FROM k, u WHERE {condition}")
#: The same on frames by region, where those that hold nowhere or everywhere above hold in some worlds.
for name in ("anded_boxed", "ored_diamonded_negated", "ored_boxed_negated"):
    base, _, how = name.partition("_")
    there = {"anded": ALL, "ored": ANY}[base].format(w="e.target")
    condition = {"boxed": f"NOT EXISTS (SELECT 1 FROM g2 e WHERE e.source = u.world AND NOT ({there}))", "diamonded_negated": f"NOT EXISTS (SELECT 1 FROM g2 e WHERE e.source = u.world AND {there})", "boxed_negated": f"EXISTS (SELECT 1 FROM g2 e WHERE e.source = u.world AND NOT ({there}))"}[how]
    add(f"scheme_lambda_{name}_g2", lambda d, n=f"lambda_{name}": schemes.scheme(d.graph("g2", "l1"), n), "g2 l1", f", {U.replace('g1', 'g2')} SELECT k.v AS formula_of, u.world FROM k, u WHERE {condition}")
TOP = RANKED.format(l="l1") + ", top AS (SELECT world, formula FROM r WHERE rank <= many - round_even(CAST(many * 0.6 AS DOUBLE), 0)), cutt AS (SELECT world, formula FROM (SELECT *, round_even(CAST(many * 0.2 AS DOUBLE), 0) AS head FROM r) h WHERE rank > head AND rank <= many - round_even(CAST((many - head) * 0.2 AS DOUBLE), 0)), " + U
CHOSEN = "EXISTS (SELECT 1 FROM {t} a JOIN l1 b ON a.formula = b.formula WHERE a.world = k.v AND b.world = {w})"
add("scheme_tfidf_top_ored", lambda d: schemes.scheme(d.graph("g1", "l1"), "tfidf_top_ored", scores(d, "l1"), 40), "g1 l1", f"{TOP} SELECT k.v AS formula_of, u.world FROM k, u WHERE {CHOSEN.format(t='top', w='u.world')}")
add("scheme_tfidf_cut_ored", lambda d: schemes.scheme(d.graph("g1", "l1"), "tfidf_cut_ored", scores(d, "l1"), 20), "g1 l1", f"{TOP} SELECT k.v AS formula_of, u.world FROM k, u WHERE {CHOSEN.format(t='cutt', w='u.world')}")
TOPD = f"EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world AND {CHOSEN.format(t='top', w='e.target')})"
add("scheme_tfidf_top_ored_diamonded", lambda d: schemes.scheme(d.graph("g1", "l1"), "tfidf_top_ored_diamonded", scores(d, "l1"), 40), "g1 l1", f"{TOP} SELECT k.v AS formula_of, u.world FROM k, u WHERE {TOPD}")
SIM = "EXISTS (SELECT 1 FROM top WHERE top.world = k.v) AND k.v IN (SELECT world FROM u) AND NOT EXISTS (SELECT 1 FROM top a WHERE a.world = k.v AND NOT EXISTS (SELECT 1 FROM l1 b WHERE b.world = u.world AND b.formula = a.formula)) AND EXISTS (SELECT 1 FROM g1 e WHERE e.source = u.world {no} AND " + CHOSEN.format(t="top", w="e.target") + ")"
add("scheme_similar_successor", lambda d: schemes.scheme(d.graph("g1", "l1"), "similar_successor", scores(d, "l1"), 40), "g1 l1", f"{TOP} SELECT k.v AS formula_of, u.world FROM k, u WHERE {SIM.format(no='')}")
add("scheme_dead_end", lambda d: partition.dead_ends(d.graph("g2", "l1")).filter("dead_end").select("world"), "g2", ", u AS (SELECT source AS world FROM g2 UNION SELECT target FROM g2) SELECT world FROM u WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.source = u.world AND g2.target <> u.world)")

# partitions
add("dead_ends", lambda d: partition.dead_ends(d.graph("g3", "l2")), "g3", ", u AS (SELECT source AS world FROM g3 UNION SELECT target FROM g3) SELECT world, NOT EXISTS (SELECT 1 FROM g3 WHERE g3.source = u.world AND g3.target <> u.world) AS dead_end FROM u")
add("community_loners", lambda d: partition.community_and_loners(d.graph("g1", "l1"), scores(d, "l1"), 40), "g1 l1", f"{TOP} SELECT u.world, EXISTS (SELECT 1 FROM k WHERE {SIM.format(no='AND e.target <> e.source')}) AS community FROM u")
add("approx_hna", lambda d: partition.approximate_authorities(d.graph("g1", "l1"), scores(d, "l1"), 40), "g1 l1", f"{TOP}, t AS (SELECT DISTINCT world AS v FROM top) SELECT u.world, (SELECT count(*) FROM t) - (SELECT count(*) FROM t k WHERE {TOPD}) > floor((SELECT count(*) FROM t) / 2.0) AS authority FROM u")
ONE, OTHER = SOME[:4], SOME[4:]
_in = lambda c, ws: f"{c} IN ({', '.join(repr(w) for w in ws)})"
add(
    "interrelation",
    lambda d: R(partition.interrelation(d.kept("g1"), d.names(*ONE), d.names(*OTHER)), "interrelation", "selectivity"),
    "g1",
    f", c AS (SELECT count(*) AS n FROM g1 WHERE ({_in('source', ONE)} AND {_in('target', OTHER)}) OR ({_in('target', ONE)} AND {_in('source', OTHER)})) SELECT round(n / {2.0 * len(ONE) * len(OTHER)}, 6) AS interrelation, round(1 - n / {2.0 * len(ONE) * len(OTHER)}, 6) AS selectivity FROM c",
)
AMONG = f"SELECT count(*) AS n FROM g1 WHERE {_in('source', SOME)} AND {_in('target', SOME)} AND source <> target"
add("avg_links_in_part", lambda d: R(partition.average_links(d.kept("g1"), d.names(*SOME)), "average"), "g1", f", c AS ({AMONG}) SELECT round(n / {float(len(SOME))}, 6) AS average FROM c")
add("part_cliqueness", lambda d: R(partition.cliqueness(d.kept("g1"), d.names(*SOME)), "cliqueness"), "g1", f", c AS ({AMONG}) SELECT round(n / {float(len(SOME) * (len(SOME) - 1))}, 6) AS cliqueness FROM c")

# clusters: worlds of L1 by the first digit of their number
CLUSTERS = "c AS (SELECT DISTINCT CAST(substr(world, 8, 1) AS INT) AS cluster, world FROM l1)"


def _clusters(d):
    return d.kept("l1").select(F.substring("world", 8, 1).cast("int").alias("cluster"), "world").distinct()


def _places(d):
    g = d.graph("g1", "l1")
    return g, cluster.positions(g, [Var(t) for t in TERMS])


JAC = "(SELECT count(*) FROM l1 a JOIN l1 b ON a.formula = b.formula WHERE a.world = {x} AND b.world = {y}) / CAST((SELECT count(DISTINCT formula) FROM l1 WHERE world IN ({x}, {y})) AS DOUBLE)"
add("jaccard", lambda d: R(_jaccard(d), "sim"), "l1", f", w AS (SELECT DISTINCT world FROM l1) SELECT p.world AS a, q.world AS b, round({JAC.format(x='p.world', y='q.world')}, 6) AS sim FROM w p, w q WHERE p.world < q.world")


def _jaccard(d):
    sets = d.kept("l1").groupBy("world").agg(F.collect_set("formula").alias("set"))
    a, b = sets.select(F.col("world").alias("a"), F.col("set").alias("x")), sets.select(F.col("world").alias("b"), F.col("set").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", measure.jaccard(F.col("x"), F.col("y")).alias("sim"))


CSIM = f"SELECT cluster, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) > 1 THEN (SELECT avg({JAC.format(x='p.world', y='q.world')}) FROM c p, c q WHERE p.cluster = c.cluster AND q.cluster = c.cluster AND p.world <> q.world) END AS sim FROM c GROUP BY cluster"
add("cluster_sim", lambda d: R(cluster.similarities(d.kept("l1"), _clusters(d)), "sim"), "l1", f", {CLUSTERS}, m AS ({CSIM}) SELECT cluster, n, round(sim, 6) AS sim FROM m")
CDIS = "SELECT p.cluster AS a, q.cluster AS b, 1 - (SELECT count(*) FROM (SELECT formula FROM t WHERE cluster = p.cluster INTERSECT SELECT formula FROM t WHERE cluster = q.cluster) x) / CAST((SELECT count(DISTINCT formula) FROM t WHERE cluster IN (p.cluster, q.cluster)) AS DOUBLE) AS dissim FROM (SELECT DISTINCT cluster FROM c) p, (SELECT DISTINCT cluster FROM c) q WHERE p.cluster <> q.cluster"
add("cluster_dissim", lambda d: R(cluster.dissimilarities(d.kept("l1"), _clusters(d)), "dissim"), "l1", f", {CLUSTERS}, t AS (SELECT DISTINCT cluster, formula FROM c JOIN l1 USING (world)), m AS ({CDIS}) SELECT a, b, round(dissim, 6) AS dissim FROM m")
CCLI = "SELECT cluster, CASE WHEN count(*) = 1 THEN 1.0 ELSE (SELECT count(*) FROM g1 JOIN c p ON p.world = source JOIN c q ON q.world = target WHERE p.cluster = c.cluster AND q.cluster = c.cluster AND source <> target) / CAST(count(*) * (count(*) - 1) AS DOUBLE) END AS cliqueness FROM c GROUP BY cluster"
add("cluster_cliqueness", lambda d: R(cluster.cliquenesses(d.kept("g1"), _clusters(d)), "cliqueness"), "g1 l1", f", {CLUSTERS}, m AS ({CCLI}) SELECT cluster, round(cliqueness, 6) AS cliqueness FROM m")
add("cluster_stats", lambda d: R(cluster.statistics(d.graph("g1", "l1"), _clusters(d)), "sim", "cliqueness"), "g1 l1", f", {CLUSTERS}, m AS ({CSIM}), q AS ({CCLI}) SELECT cluster, n, round(sim, 6) AS sim, round(cliqueness, 6) AS cliqueness FROM m JOIN q USING (cluster)")
add("cluster_averages", lambda d: R(cluster.averages(d.graph("g1", "l1"), _clusters(d)), "avg_sim", "avg_cliqueness", "avg_dissim"), "g1 l1", f", {CLUSTERS}, t AS (SELECT DISTINCT cluster, formula FROM c JOIN l1 USING (world)), m AS ({CSIM}), q AS ({CCLI}), x AS ({CDIS}) SELECT (SELECT round(avg(sim), 6) FROM m) AS avg_sim, (SELECT round(avg(cliqueness), 6) FROM q) AS avg_cliqueness, (SELECT round(avg(dissim), 6) FROM x) AS avg_dissim")
add("clique_edges", lambda d: _clusters(d).groupBy("cluster").agg(count("n")).select("cluster", measure.clique_edges(F.col("n")).alias("edges")), "l1", f", {CLUSTERS} SELECT cluster, count(*) * (count(*) - 1) AS edges FROM c GROUP BY cluster")

DIMS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS))
SPACE = f", u AS (SELECT source AS world FROM g1 UNION SELECT target FROM g1), dims(dim, formula) AS (VALUES {DIMS}), p AS (SELECT DISTINCT u.world, dim FROM u JOIN l1 USING (world) JOIN dims USING (formula))"
add("fml_space", lambda d: _places(d)[1], "g1 l1", SPACE + " SELECT world, dim FROM p")
add(
    "bools_dist",
    lambda d: R(_distances(d), "dist"),
    "g1 l1",
    SPACE + " SELECT a.world AS a, b.world AS b, round(sqrt((SELECT count(*) FROM (SELECT dim FROM p WHERE world IN (a.world, b.world) GROUP BY dim HAVING count(*) = 1) x)), 6) AS dist FROM u a, u b WHERE a.world < b.world",
)


def _distances(d):
    g, places = _places(d)
    dense = g.linked.join(places.groupBy("world").agg(F.collect_set("dim").alias("dims")), "world", "left").select("world", F.transform(F.sequence(F.lit(0), F.lit(len(TERMS) - 1)), lambda i: F.coalesce(F.array_contains("dims", i), F.lit(False))).alias("bits"))
    a, b = dense.select(F.col("world").alias("a"), F.col("bits").alias("x")), dense.select(F.col("world").alias("b"), F.col("bits").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", measure.bools_distance(F.col("x"), F.col("y")).alias("dist"))


CENTROIDS = [[i % 2 == 0 for i in range(len(TERMS))], [i % 3 == 1 for i in range(len(TERMS))], [i < 4 for i in range(len(TERMS))]]


def kmeans_sql(rounds: int) -> str:
    values = ", ".join(f"({k}, {i})" for k, c in enumerate(CENTROIDS) for i, b in enumerate(c) if b)
    sql = SPACE + f", ks AS (SELECT unnest([0, 1, 2]) AS k), c0(k, dim) AS (VALUES {values})"
    for r in range(rounds):
        sql += f", d{r} AS MATERIALIZED (SELECT u.world, ks.k, (SELECT count(*) FROM p WHERE p.world = u.world) + (SELECT count(*) FROM c{r} c WHERE c.k = ks.k) - 2 * (SELECT count(*) FROM p JOIN c{r} c ON c.dim = p.dim WHERE p.world = u.world AND c.k = ks.k) AS dist FROM u, ks)"
        sql += f", a{r} AS MATERIALIZED (SELECT world, min(k) AS k FROM d{r} d WHERE dist = (SELECT min(dist) FROM d{r} e WHERE e.world = d.world) GROUP BY world)"
        sql += f", c{r + 1} AS MATERIALIZED (SELECT k, dim FROM a{r} JOIN p USING (world) GROUP BY k, dim HAVING 2 * count(*) >= (SELECT count(*) FROM a{r} b WHERE b.k = a{r}.k) UNION SELECT k, dim FROM c{r} WHERE k NOT IN (SELECT k FROM a{r}))"
    return sql + f" SELECT CAST(k AS INT) AS cluster, world FROM a{rounds - 1}"


def _kmeans(d, rounds=4):
    g, places = _places(d)
    return cluster.k_means(g.linked, places, CENTROIDS, rounds)[0]


add("kmeans_bool", _kmeans, "g1 l1", kmeans_sql(4))


def _dynamic(d):
    g, places = _places(d)
    return cluster.dynamic_k_means(g, g.linked, places, CENTROIDS)[0]


add("dyn_kmeans", _dynamic)


def _single(d, hierarchy=False):
    g, places = _places(d)
    return (cluster.single_link_hierarchy if hierarchy else cluster.single_link_edges)(g.linked, places)


APART = SPACE + ", e AS (SELECT a.world AS source, b.world AS target, (SELECT count(*) FROM (SELECT dim FROM p WHERE world IN (a.world, b.world) GROUP BY dim HAVING count(*) = 1) x) AS apart FROM u a, u b WHERE a.world < b.world), l AS (SELECT dense_rank() OVER (ORDER BY apart) AS level, source, target, apart FROM e)"
add("single_link_edges", lambda d: R(_single(d), "dist"), "g1 l1", APART + " SELECT level, source, target, round(sqrt(apart), 6) AS dist FROM l")
HIER = """, n AS (SELECT DISTINCT level FROM l), w AS (SELECT source AS world FROM l UNION SELECT target FROM l),
 t AS (SELECT n.level, source, target FROM n JOIN l ON l.level <= n.level UNION SELECT n.level, target, source FROM n JOIN l ON l.level <= n.level),
 r AS (SELECT level, source AS world, target AS other FROM t UNION SELECT r.level, r.world, t.target FROM r JOIN t ON t.level = r.level AND t.source = r.other),
 c AS (SELECT level, world, least(world, min(other)) AS label FROM r GROUP BY level, world),
 s AS (SELECT level, list_sort(list(world || '>' || label)) AS state FROM c GROUP BY level),
 k AS (SELECT level FROM (SELECT level, state, lag(state) OVER (ORDER BY level) AS before FROM s) x WHERE before IS NULL OR state <> before)
SELECT level, label, world FROM c WHERE level IN (SELECT level FROM k)"""
add("single_link_hier", lambda d: _single(d, True).select("level", "label", "world"), "g1 l1", APART + HIER)

__all__ = ["LISTED", "W", "nodes"]
