"""URL filters: host rules, and trust and distrust spread over the link graph for the hosts no rule decides.

Hosts are linked by the links of their pages to other hosts, an edge weighing its share of the host's links.  Personalised
PageRank carries trust along the edges from hosts by the share of their pages that an allow rule fits, and distrust against the
edges (to those that link to them) from hosts by the share that a block rule fits.  Scores are scaled so that a host that no
edge reaches scores its own share.  A page that no rule fits gets its host's verdict: block if distrust exceeds trust by
``MARGIN``, else allow.

Edges are counted once for each pair of hosts before anything is joined, so a host that holds a third of the pages is one row.
Scores pass from round to round through tables in the shared folder.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; a null page has no
links; repeated rows are judged each and count as often in shares; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, source_table

#: The rules of the query, as (what a fitting url gets, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
FOLLOW, SWEEPS, KEPT_EVERY, MARGIN = 0.85, 10, 5, 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, links): links between different hosts, counted; pages as (host, html)."""
    found = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'#\s>]*)"), 1)
    target = F.when(F.col("link").rlike("(?i)^(https?:)?//"), F.coalesce(F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit("")))
    target = target.when(~F.col("link").rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.col("host"))
    links = pages.filter("host != ''").select("host", F.explode(found).alias("link")).select(F.col("host").alias("source"), target.alias("target"))
    return links.filter("target != '' and target != source").groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(host, trust, distrust) after so many rounds; seeds as (host, trusted, blocked) with shares from 0 to 1."""
    out = edges.groupBy("source").agg(F.sum("links").alias("total"))
    into = edges.groupBy("target").agg(F.sum("links").alias("total"))
    along = edges.join(out, "source").select(F.col("source").alias("at"), F.col("target").alias("to"), (F.col("links") / F.col("total")).alias("ahead"), F.lit(0.0).alias("back"))
    against = edges.join(into, "target").select(F.col("target").alias("at"), F.col("source").alias("to"), F.lit(0.0).alias("ahead"), (F.col("links") / F.col("total")).alias("back"))
    flows = saved(along.union(against).groupBy("at", "to").agg(F.sum("ahead").alias("ahead"), F.sum("back").alias("back")), "flows")
    hosts = seeds.select("host").union(flows.select("at")).distinct().join(seeds, "host", "left")
    base = saved(hosts.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trusted", "blocked"))), "seeds")
    scores = base.select("host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    for i in range(1, sweeps + 1):
        moved = flows.join(scores, flows["at"] == scores["host"]).groupBy("to").agg(F.sum(F.col("ahead") * F.col("trust")).alias("t"), F.sum(F.col("back") * F.col("distrust")).alias("d"))
        mixed = lambda seed, got: F.col(seed) + FOLLOW * F.coalesce(F.col(got), F.lit(0.0))
        scores = base.join(moved, base["host"] == moved["to"], "left").select("host", mixed("trusted", "t").alias("trust"), mixed("blocked", "d").alias("distrust"))
        if i % KEPT_EVERY == 0 or i == sweeps:
            scores = saved(scores, "scores")
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each page."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    ruled = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    share = lambda what: F.avg(F.when(F.col("said") == what, 1.0).otherwise(0.0))
    seeds = ruled.filter("host != ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = spread(saved(host_edges(rows), "host-edges"), saved(seeds, "shares"))
    met = ruled.join(scores, "host", "left")
    blocked = F.coalesce(F.col("distrust") - F.col("trust") >= margin, F.lit(False))
    return met.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "trust", "distrust")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    found = judge(source_table(spark, sf_dir, "pages"))
    return found.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})
