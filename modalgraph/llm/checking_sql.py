"""SQL that gives the rows of those training-data queries that SQL can express, built from the operators' own constants."""

from __future__ import annotations

from . import licenses, url_filters

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def url_filters_sql(sweeps: int = url_filters.SWEEPS) -> str:
    """Rules by the longest fit, links by pattern, and the sweeps one after the other."""
    rules = ", ".join(f"({_text(what)}, {_text(r)}, {_text(r.partition('/')[0])}, {_text('/' + r.partition('/')[2])})" for what, r in url_filters.RULES)
    host = lambda url: f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"
    sql = f"""WITH rules(what, rule, name, start) AS (VALUES {rules}),
 p AS (SELECT row_number() OVER () AS i, page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 fit AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS said FROM p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY i),
 r AS (SELECT p.i, page_id, host, path, rule, said FROM p LEFT JOIN fit ON fit.i = p.i),
 seed AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS trusted, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM r WHERE host <> '' GROUP BY host),
 a AS (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''#\\s>]*)', 1)) AS link FROM p WHERE host <> ''),
 t AS (SELECT host AS source, CASE WHEN regexp_matches(link, '(?i)^(https?:)?//') THEN translate(regexp_extract(link, '//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') WHEN NOT regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN host END AS target FROM a),
 e AS (SELECT source, target, count(*) AS n FROM t WHERE target <> '' AND target <> source GROUP BY source, target),
 w AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS ahead, n / sum(n) OVER (PARTITION BY target) AS back FROM e),
 h AS (SELECT host FROM seed UNION SELECT source FROM e UNION SELECT target FROM e),
 b AS (SELECT host, coalesce(trusted, 0.0) AS trusted, coalesce(blocked, 0.0) AS blocked FROM h LEFT JOIN seed USING (host)),
 s0 AS (SELECT host, trusted AS trust, blocked AS distrust FROM b)"""
    for k in range(1, sweeps + 1):
        sql += f""",
 s{k} AS MATERIALIZED (SELECT host, trusted + {url_filters.FOLLOW} * coalesce((SELECT sum(ahead * trust) FROM w JOIN s{k - 1} s ON s.host = w.source WHERE w.target = b.host), 0) AS trust,
   blocked + {url_filters.FOLLOW} * coalesce((SELECT sum(back * distrust) FROM w JOIN s{k - 1} s ON s.host = w.target WHERE w.source = b.host), 0) AS distrust FROM b)"""
    return (
        sql
        + f"""
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN distrust - trust >= {url_filters.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 6) AS trust, round(distrust, 6) AS distrust FROM r LEFT JOIN s{sweeps} s ON s.host = r.host"""
    )


def licenses_sql(similarity: float = licenses.SIMILARITY) -> str:
    """Weights from the templates' texts, windows where telling terms lie, and ancestors by prefixes of paths."""
    texts = [(name, t) for name, found in licenses.TEMPLATES.items() for t in found]
    values = ", ".join(f"({k}, {_text(name)}, {_text(t)})" for k, (name, t) in enumerate(texts))
    split = lambda text: f"list_filter(regexp_split_to_array(translate({text}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""WITH said(k, name, text) AS (VALUES {values}),
 tpl AS (SELECT k, name, {split("text")} AS terms FROM said),
 lie AS (SELECT k, unnest(terms) AS term, unnest(range(len(terms))) AS place FROM tpl),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM said)) / (1 + count(DISTINCT k))) + 1 AS w FROM lie GROUP BY term),
 bag AS (SELECT k, term, count(*) * any_value(w) AS y FROM lie JOIN idf USING (term) GROUP BY k, term),
 long AS (SELECT k, sqrt(sum(y * y)) AS size FROM bag GROUP BY k),
 vec AS (SELECT k, term, y / size AS x FROM bag JOIN long USING (k)),
 tell AS (SELECT k, term, place FROM (SELECT k, term FROM vec JOIN idf USING (term) QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(w, 9) DESC, length(term) DESC, term) <= {licenses.TELLING}) x JOIN lie USING (k, term)),
 d AS (SELECT row_number() OVER () AS i, doc_id, {split("coalesce(text, '')")} AS terms, coalesce(source, '') || '/' || coalesce(CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), '') || '/' AS home, coalesce(CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), '') || '/' AS hundred FROM documents),
 f AS (SELECT i, doc_id, terms, home || CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' WHEN doc_id % 10 = 0 THEN hundred || 'LICENSE' ELSE hundred || coalesce(CAST(doc_id AS VARCHAR), '') || '.txt' END AS path FROM d),
 hit AS (SELECT i, place, term FROM (SELECT i, unnest(terms) AS term, unnest(range(len(terms))) AS place FROM f) x WHERE term IN (SELECT term FROM tell)),
 win AS (SELECT DISTINCT i, k, hit.place - tell.place AS start FROM hit JOIN tell USING (term)),
 cut AS (SELECT i, k, list_slice(f.terms, greatest(start, 0) + 1, least(start + len(tpl.terms), len(f.terms))) AS part FROM win JOIN f USING (i) JOIN tpl USING (k)),
 u AS (SELECT DISTINCT part FROM cut),
 m AS (SELECT part, term, count(*) AS n FROM (SELECT part, unnest(part) AS term FROM u) x GROUP BY part, term),
 q AS (SELECT part, sqrt(sum((n * coalesce(w, (SELECT ln(1 + count(*)) + 1 FROM said))) ** 2)) AS norm FROM m LEFT JOIN idf USING (term) GROUP BY part),
 s AS (SELECT part, k, round(sum(n * w * x) / any_value(norm), 9) AS score FROM m JOIN idf USING (term) JOIN vec USING (term) JOIN q USING (part) GROUP BY part, k),
 o AS (SELECT i, k, name, score, round(score * CASE WHEN name = {_text(licenses.RESERVATION)} THEN 0 ELSE size END, 6) AS mass FROM cut JOIN s USING (part, k) JOIN said USING (k) JOIN long USING (k) WHERE score >= {similarity}),
 b AS (SELECT i, k, name AS own_license, score AS own_score, mass FROM o QUALIFY row_number() OVER (PARTITION BY i ORDER BY mass DESC, score DESC, k) = 1),
 g AS (SELECT f.i, doc_id, path, regexp_extract(path, '(?s)^(.*)/[^/]*$', 1) AS dir, k, own_license, own_score, mass FROM f LEFT JOIN b USING (i)),
 l AS (SELECT dir AS up, own_license AS given FROM g WHERE path LIKE '%/LICENSE' AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, mass DESC, k) = 1),
 v AS (SELECT g.i, up, given, row_number() OVER (PARTITION BY g.i ORDER BY length(up) DESC) AS near FROM g JOIN l ON up = '' OR dir = up OR starts_with(dir, up || '/') WHERE own_license IS NULL)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license, CASE WHEN own_license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS license_source, up AS license_dir
FROM g LEFT JOIN v ON v.i = g.i AND v.near = 1"""
