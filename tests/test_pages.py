import pytest

from modalgraph.functions.snowball import stem
from modalgraph.functions.terms import is_term, stop_words, terms, tokens
from modalgraph.model import Graph
from modalgraph.sources import crawl, pages
from modalgraph.sources.pages import Page
from modalgraph.sources.store import Store

HTML = """<!DOCTYPE html><html lang="de-AT"><head><title>Grosse Katze</title><meta name="Keywords" content="hund,maus">
<meta http-equiv="description" content="ein tier"><link rel="alternate" type="application/rss+xml" href="rss.xml">
<link rel="alternate" type="application/atom+xml" href="/atom.xml"></head><body><h2>Zweites</h2><h1>Erstes <b>fett</b></h1>
<script>var hidden = "<p>";</script><style>p{}</style><p>Laufen &amp; springen</p><a href="/x">Verweis hier</a>
<a href="http://b.com/y">other</a><a href="http://a.com.evil/z">evil</a><a href="mailto:me@a.com">mail</a></body></html>"""


def test_parts_of_a_page():
    page = Page(HTML)
    assert page.lang == "de-AT"
    assert page.titles == ["Grosse Katze"]
    assert page.headlines["h1"] == ["Erstes "] and page.headlines["h2"] == ["Zweites"]
    assert page.meta == {"keywords": "hund,maus", "description": "ein tier"}
    assert page.feed_link == "/atom.xml"
    text = "".join(page.text)
    assert "hidden" not in text and "p{}" in text and "& springen" in text


def test_unclosed_script_and_missing_parts():
    page = Page("<p>seen</p><script>never closed")
    assert "".join(page.text) == "seen"
    assert page.lang is None and page.feed_link is None and page.titles == []
    assert Page("").text == []
    assert Page('<html xml:lang="fr">').lang == "fr"


def test_titles_with_references_without_a_semicolon():
    page = Page("<title>a &amp;&amp &copy;</title>")
    assert page.closed["title"] == ["a &&amp ©"] and page.titles == ["a && ©"]


def test_references_without_a_semicolon():
    page = Page('<h1>a &amp;&amp &copy;</h1><p>b &copy 1</p><style>c&amp;d &lt</style><h2><style>e&amp;f</style></h2><a href="/x?a&amp;b&lt">g &amp</a>&quot')
    assert page.closed["h1"] == ["a &&amp ©"] and page.headlines["h1"] == ["a && ©"]
    assert page.closed["h2"] == page.headlines["h2"] == ["e&amp;f"]
    assert "".join(page.text) == 'a && ©b © 1c&amp;d &lte&amp;fg &"'
    assert page.links == ["/x?a&b<"] and page.anchors == [["g &"]]


def test_tokens():
    assert tokens("Don't stop, http://a.b/c. (it's)") == ["Do", "n't", "stop", ",", "http://a.b/c.", "(", "it", "'s", ")"]


@pytest.mark.parametrize(("word", "kept"), [("a", False), ("ab", False), ("abc", True), ("x" * 80, True), ("x" * 81, False), ("ours", True), ("the", False), ("über", False), ("ab1", False), ("--", False), ("wörter", True), ("dieselbte", False)])
def test_term_filter(word, kept):
    assert is_term(word) is kept


def test_stop_words_and_terms():
    assert {"zwischen", "hinaus", "seitdem", "jeweiligen", "you're"} <= set(stop_words())
    assert terms("The CAT sat, on 3 mats") == ["cat", "sat", "mats"]


@pytest.mark.parametrize(
    ("language", "pairs"),
    [
        ("english", {"consistency": "consist", "knightly": "knight", "generously": "generous", "skies": "sky", "hopping": "hop", "relational": "relat", "happy": "happi", "ties": "tie", "cries": "cri"}),
        ("german", {"aufeinanderfolgenden": "aufeinanderfolg", "häuser": "haus", "kategorischen": "kategor", "katers": "kat", "verträglichkeit": "vertrag"}),
        ("spanish", {"chicharrones": "chicharron", "torneados": "torn", "cheque": "chequ"}),
        ("french", {"continuellement": "continuel", "majestueusement": "majestu", "continuité": "continu", "mainte": "maint", "chevaux": "cheval", "majorité": "major", "constamment": "const", "parlait": "parl", "finissons": "fin", "maître": "maîtr"}),
        ("swedish", {"jaktkarlarne": "jaktkarl", "klostren": "klostr"}),
        ("italian", {"abbandonata": "abbandon", "abbandoneranno": "abbandon", "abbassandola": "abbass", "pronunciamento": "pronunc", "pronunziò": "pronunz", "propagazione": "propag", "propaghino": "propaghin"}),
        ("portuguese", {"boataria": "boat", "boatos": "boat", "bobagens": "bobagens", "quilômetro": "quilômetr", "quinhão": "quinhã", "quintal": "quintal"}),
        ("romanian", {"abruptă": "abrupt", "absolvenţii": "absolvenţ", "ocolesc": "ocol", "ocupaţie": "ocup"}),
        ("russian", {"вагонов": "вагон", "важнейшие": "важн", "важничал": "важнича", "важностью": "важност", "павильон": "павильон", "в": "в"}),
        ("hungarian", {"babakocsijáért": "babakocs", "babrálni": "babráln", "babérjaikat": "babér", "babérkoszorúkkal": "babérkoszorú"}),
        (None, {"anything": "anything"}),
        ("finnish", {"sana": "sana"}),
    ],
)
def test_stems(language, pairs):
    assert {w: stem(w, language) for w in pairs} == pairs


@pytest.fixture(scope="module")
def corpus(spark):
    other = '<html><title>Tail</title><body>plain text <a href="http://a.com/p">back</a></body></html>'
    feed = "<html><title>Newsitem</title></html>"
    return spark.createDataFrame([("http://a.com/p", HTML), ("http://b.com/y", other), ("http://a.com/p/atom.xml", feed), ("http://c.com", None)], "url string, html string")


def test_links(corpus, rows):
    found = pages.parsed(corpus)
    assert rows(pages.page_links(found)) == [("http://a.com/p", "http://a.com.evil/z"), ("http://a.com/p", "http://a.com/x")]
    assert rows(pages.host_links(found)) == [("http://a.com", t) for t in ("http://a.com", "http://a.com.evil", "http://b.com")] + [("http://b.com", "http://a.com")]
    assert rows(pages.page_language(found)) == [("http://a.com/p", "german"), ("http://a.com/p/atom.xml", "english"), ("http://b.com/y", "english"), ("http://c.com", "english")]
    assert rows(pages.feed_links(found)) == [("http://a.com/p", "http://a.com/p/atom.xml")]


def test_labels(corpus, rows):
    found = pages.parsed(corpus)
    main = dict((f, n) for w, f, n in rows(pages.labels(found, "MtaRaw")) if w == "http://a.com/p")
    assert main == {"hund": 1, "maus": 1, "tier": 1, "grosse": 1, "katze": 1, "erstes": 1, "zweites": 1, "verweis": 1, "evil": 1, "mail": 1, "newsitem": 1}
    stems = dict((f, n) for w, f, n in rows(pages.labels(found, "BdyStem")) if w == "http://a.com/p")
    assert stems["katz"] == 1 and "katze" not in stems
    codes = {f for w, f, _ in rows(pages.labels(found, "BdySoundex"))}
    assert "G620" in codes and all(len(c) == 4 for c in codes)
    folded = rows(pages.folded(pages.labels(found, "MtaRaw")), "world")
    assert {w for (w,) in folded} == {"http://a.com", "http://b.com"}
    with pytest.raises(ValueError, match="lambda type"):
        pages.labels(found, "Other")


def test_crawl(spark, rows):
    links = spark.createDataFrame([("s", "a"), ("a", "b/"), ("b", "c"), ("c", "d")], "source string, target string")
    assert rows(crawl.crawl(links, "s", 1)) == [("s", "a")]
    assert rows(crawl.crawl(links, "s/", 3)) == [("a", "b/"), ("b", "c"), ("s", "a")]
    with pytest.raises(ValueError, match="depth"):
        crawl.crawl(links, "s", 0)


def test_store(spark, corpus, rows, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert rows(store.table("links")) == []
    store.add_pages(corpus)
    store.add_pages(corpus)
    assert len(rows(store.table("links"))) == 4
    store.build_labels(corpus)
    with pytest.raises(ValueError, match="score_labels"):
        store.stored_scores("MtaRaw", "http://a.com/p")
    store.score_labels()
    assert len(store.stored_scores("MtaRaw", "http://a.com/p").collect()) == 11
    store.rank_links(3)
    assert {w for w, _ in rows(store.table("pagerank"))} == {"http://a.com", "http://b.com"}
    assert isinstance(store.graph("BdyRaw"), Graph)
