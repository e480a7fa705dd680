"""Queries on pages: addresses, parsed parts, terms and crawls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.terms import ENGLISH, is_term_column, joined_url, language, soundex_code, stop_words, url_domain, without_last_slash
from ..model import LAMBDA_TYPES
from ..operators import lookup
from ..sources import crawl, pages
from ..sources.shared import saved
from .registry import add

DOMAIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
UNESCAPED = "replace(replace(replace(replace(replace({h}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
#: Resolving against an address drops what follows its path, and a path keeps its own query.
LINKS = f", a AS (SELECT url, {UNESCAPED.format(h='h')} AS h FROM (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS h FROM pages) x)"

_parsed = lambda d: pages.parsed(d.table("pages"))
_cut = lambda d: saved(_parsed(d), "parsed")
_cut_languages = lambda d: saved(_languages(d), "languages")

add("url_domain", lambda d: d.table("pages").select("url", url_domain(F.col("url")).alias("domain")), "", f"SELECT url, {DOMAIN} AS domain FROM pages")
add("url_key", lambda d: d.table("pages").select("url", without_last_slash(F.col("url")).alias("key"), joined_url(F.col("url"), F.lit("/feed")).alias("joined")), "", "SELECT url, regexp_replace(url, '/$', '') AS key, regexp_replace(url, '/$', '') || '/feed' AS joined FROM pages")
add("html_lang", lambda d: _parsed(d).select("url", "lang"), "", "SELECT url, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
add("page_title", lambda d: _parsed(d).select("url", F.when(F.col("title").isNotNull(), F.coalesce(F.get("title", 0), F.lit(""))).alias("title")), "", f"SELECT url, {UNESCAPED.format(h='t')} AS title FROM (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages) x")
add("page_headlines", lambda d: _parsed(d).select("url", F.explode("headlines").alias("headline")), "", f"SELECT url, {UNESCAPED.format(h='t')} AS headline FROM (SELECT url, unnest(regexp_extract_all(html, '<h1>([^<]+)</h1>', 1)) AS t FROM pages) x")
add("feed_link", lambda d: pages.feed_links(_parsed(d)), "", "SELECT url AS world, '' AS feed FROM pages WHERE html LIKE '%<link rel=%'")
REL = LINKS + f", l AS (SELECT DISTINCT url AS source, {DOMAIN} || h AS target FROM a WHERE h LIKE '/%')"
add("links_rel", lambda d: pages.page_links(_parsed(d)), "g4", REL + " SELECT source, target FROM l")
add("links_abs", lambda d: pages.host_links(_parsed(d)), "", f"SELECT DISTINCT {DOMAIN} AS source, {DOMAIN} AS target FROM pages WHERE html LIKE '%<a href=%'")
add("stem_language", lambda d: pages.page_language(_parsed(d)), "", "SELECT url AS world, language FROM (SELECT url, CASE regexp_extract(html, '<html lang=\"([^\"-]*)', 1) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language FROM pages) x WHERE language IS NOT NULL")
_languages = lambda d: pages.page_language(_parsed(d))
LANGUAGES = "SELECT url AS world, CASE regexp_extract(html, '<html lang=\"([^\"-]*)', 1) WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language FROM pages"
FIRST = "(SELECT min(url) FROM pages)"
add("stem_lang", lambda d: lookup.stem_language(_cut_languages(d), d.table("pages").agg(F.min("url")).head()[0]), "", f"SELECT coalesce(max(language), '') AS language FROM ({LANGUAGES}) x WHERE world = {FIRST}")
add("stem_lang_unknown", lambda d: lookup.stem_language(_cut_languages(d), "http://nowhere"), "", f"SELECT coalesce(max(language), '') AS language FROM ({LANGUAGES}) x WHERE world = 'http://nowhere'")
add("delete_stem_lang", lambda d: lookup.without_world(_cut_languages(d), d.table("pages").agg(F.min("url")).head()[0]), "", f"SELECT world, language FROM ({LANGUAGES}) x WHERE language IS NOT NULL AND world <> {FIRST}")
add("page_meta", lambda d: _parsed(d).select("url", F.explode("meta").alias("formula")), "", "SELECT url, '' AS formula FROM pages WHERE html LIKE '%<meta name=%'")
#: Pages of these tables have neither meta tags nor feeds, so both are put where each page names its character set.
PUT = '<meta name="keywords" content="Graph, worlds,the"><link rel="alternate" type="application/atom+xml" href="/feed/1"><meta charset="utf-8">'
_put = lambda d: pages.parsed(d.table("pages").withColumn("html", F.replace("html", F.lit('<meta charset="utf-8">'), F.lit(PUT))))
add("page_meta_put", lambda d: _put(d).select("url", F.explode("meta").alias("formula")), "", "SELECT url, unnest(['graph', 'worlds']) AS formula FROM pages WHERE html LIKE '%<meta charset=\"utf-8\">%'")
add("feed_link_put", lambda d: pages.feed_links(_put(d)), "", "SELECT url AS world, regexp_replace(url, '/$', '') || '/feed/1' AS feed FROM pages WHERE html LIKE '%<meta charset=\"utf-8\">%'")
add("page_link_texts", lambda d: _parsed(d).select("url", F.explode("link_texts").alias("formula")))
add("page_body_terms", lambda d: pages.raw_terms(_parsed(d), main=False).groupBy("world").agg(F.count(F.lit(1)).alias("n")))
add("subsites", lambda d: d.table("pages").select("url").filter(F.col("url") != url_domain(F.col("url"))), "", f"SELECT url FROM pages WHERE url <> {DOMAIN}")
_ends = {"com": "english", "org": "english", "net": None, "de": "german", "ru": "russian"}
add("tld_language", lambda d: d.names(*[f"www.example.{e}" for e in _ends], column="host").select("host", language(F.lit(None).cast("string"), F.col("host")).alias("language")), "", "SELECT host, language FROM (VALUES " + ", ".join(f"('www.example.{e}', {repr(v) if v else 'NULL'})" for e, v in _ends.items()) + ") t(host, language)")
_words = lambda d: d.table("documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("formula")).distinct()
add("term_filter", lambda d: _words(d).filter(is_term_column(F.col("formula"))), "", "SELECT formula FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS formula FROM documents) x WHERE length(formula) BETWEEN 2 AND 80 AND regexp_matches(formula, '\\p{L}') AND NOT regexp_matches(formula, '[#$%()*,0-9:;<>@\\[\\]{|}§]') AND formula NOT IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + ")")
#: Letters by the digit of their sound; vowels and all that are no such letters part equal sounds, H and W (7) do not.
SOUNDS = "01230127022455012623017202"


def soundex_sql(term: str) -> str:
    """A sound code by text functions: equal neighbours count once, vowels not at all."""
    letters = f"regexp_replace(translate(regexp_replace({term}, '^[^A-Za-z]+', ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', 'A', 'g')"
    digits = f"translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{SOUNDS}')"
    run = f"(substr({digits}, 1, 1) || replace(substr({digits}, 2), '7', ''))"
    for d in "0123456":
        run = f"regexp_replace({run}, '{d}+', '{d}', 'g')"
    return f"substr({letters}, 1, 1) || rpad(substr(replace(substr({run}, 2), '0', ''), 1, 3), 3, '0')"


add("soundex_terms", lambda d: _words(d).select("formula", soundex_code(F.col("formula")).alias("code")).filter("code is not null"), "", f"SELECT formula, {soundex_sql('formula')} AS code FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\\s+')) AS formula FROM documents) x WHERE regexp_matches(formula, '[A-Za-z]')")
for kind in LAMBDA_TYPES:
    part, form = ("main" if kind.startswith("Mta") else "body"), kind[3:].lower()
    add(f"lambda_{part}_{form}", lambda d, k=kind: pages.labels(_cut(d), k))
add("fold_lambda", lambda d: pages.folded(pages.labels(_cut(d), "BdyRaw")))


def _crawl(d, depth):
    links = saved(pages.page_links(_parsed(d)), "links")
    return crawl.crawl(links, d.table("pages").agg(F.min("url")).head()[0], depth)


CRAWL = REL + ", k AS (SELECT regexp_replace(source, '/$', '') AS key, source, target FROM l), v1 AS (SELECT regexp_replace(min(url), '/$', '') AS key FROM pages), v2 AS (SELECT key FROM v1 UNION SELECT regexp_replace(target, '/$', '') FROM k WHERE key IN (SELECT key FROM v1))"
for n in (1, 2):
    add(f"crawl_depth_{n}", lambda d, n=n: _crawl(d, n), "g4", CRAWL + f" SELECT DISTINCT source, target FROM k WHERE key IN (SELECT key FROM v{n})")
add("fixture_page_links", lambda d: d.rows("g4"), "g4", "SELECT source, target FROM g4")

__all__ = ["ENGLISH"]
