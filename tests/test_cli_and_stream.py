import pytest

from modalgraph import cli
from modalgraph.functions.formula import parse
from modalgraph.streaming.ingest import arrived, ingest

PAGES = [
    ("http://a.com", '<html lang="en"><title>Running dogs</title><a href="http://b.com">link</a><a href="/sub">own</a></html>'),
    ("http://b.com", '<html><title>Cats</title><a href="http://c.com/">link</a> dogs</html>'),
    ("http://c.com", "<html><title>Birds</title></html>"),
    ("http://a.com/sub", "<html><title>Subsite</title></html>"),
]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    spark.createDataFrame(PAGES, "url string, html string").write.parquet(f"file://{folder}/pages")
    return f"file://{folder}"


def asked(spark, where, *options):
    return {n: cli.shown(n, rows) for n, rows in cli.run(spark, ["--store", f"{where}/store", "--pages", f"{where}/pages", *options])}


def test_build_and_query(spark, where):
    assert asked(spark, where, "-d", "2", "-R", "http://a.com", "-l", "--tfidfcalc", "-p", "2") == {}
    got = asked(spark, where, "--plformula", "(Var dogs)", "--pmlformula", "(<> (Var cats))", "--outlinkrings", "http://a.com", "--rsetlamlist", "dogs cats", "--lambdatype", "MtaRaw", "-g", "cats", "-t", "http://b.com", "--lamaccum", "--rsetworldsols", "http://b.com")
    assert got["plformula"] == ["http://a.com"]
    assert got["pmlformula"] == ["http://a.com"]
    assert got["outlinkrings"] == ["http://a.com    http://b.com    http://c.com"]
    assert got["rsetlamlist"] == ["http://a.com\tFalse\tTrue", "http://b.com\tFalse\tTrue"]
    assert got["rsetworldsols"] == ["http://b.com\tTrue\tTrue"]
    assert [x.split("\t")[0] for x in got["tfidfsearch"]] == ["http://b.com"]
    assert [x.split("\t")[0] for x in got["tfidf"]] == ["link", "cats"]
    assert got["lamaccum"][0].startswith("link\t2\t")


def test_formulas_take_the_stem_of_each_world(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [
        ("http://a.com", '<html lang="en"><body>running kinder <a href="http://b.de">x</a></body></html>'), ("http://b.de", '<html lang="de"><body>Kindern running <a href="http://c.net">x</a></body></html>'),
        ("http://c.net", "<html><body>running kindern</body></html>"),
    ]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{folder}/pages")
    stem = ("--lambdatype", "BdyStem")
    assert asked(spark, folder, "-R", "http://a.com", "-d", "3", "-l") == {}
    assert asked(spark, folder, "--plformula", "(Var runs)", *stem)["plformula"] == ["http://a.com"]
    assert asked(spark, folder, "--plformula", "(Var kinder)", *stem)["plformula"] == ["http://a.com", "http://b.de"]
    assert asked(spark, folder, "--plformula", "(Var running)", *stem)["plformula"] == ["http://a.com", "http://b.de", "http://c.net"]
    assert asked(spark, folder, "--pmlformula", "(<> (Var kinder))", *stem)["pmlformula"] == ["http://a.com"]
    assert [x.split("\t")[0] for x in asked(spark, folder, "-g", "kinder", *stem)["tfidfsearch"]] == ["http://a.com", "http://b.de"]


def test_labels_of_pages_fold_into_their_domains(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [("http://a.com", '<html lang="en"><title>dogs</title><a href="http://a.com/sub">x</a></html>'), ("http://a.com/sub", '<html lang="en"><title>dogs cats</title></html>')]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{folder}/pages")
    asked(spark, folder, "--relaccrel", "http://a.com", "-l")
    assert asked(spark, folder, "--plformula", "(Var cats)", "--lambdatype", "MtaRaw")["plformula"] == ["http://a.com/sub"]
    got = asked(spark, folder, "--foldlambda", "--tfidfcalc", "--lamaccum", "--plformula", "(Var cats)", "--lambdatype", "MtaRaw")
    assert got["plformula"] == ["http://a.com"] and got["lamaccum"][0].startswith("dogs\t2\t")
    assert [r["world"] for r in spark.read.parquet(f"{folder}/store/world_stem_lang").collect()] == ["http://a.com"]


def test_links_within_a_host(spark, where):
    cli.run(spark, ["--store", f"{where}/other", "--pages", f"{where}/pages", "--relaccrel", "http://a.com"])
    assert [tuple(r) for r in spark.read.parquet(f"{where}/other/links").collect()] == [("http://a.com", "http://a.com/sub")]


def test_crawls_need_pages(spark, where):
    with pytest.raises(SystemExit):
        cli.run(spark, ["--store", f"{where}/store", "-R", "http://a.com"])


def test_atoms_take_the_form_of_the_labels(spark):
    f = parse("(And (Var running) (Not (Var Dogs)))")
    assert cli.as_lambda_type(spark, f, "BdyRaw") == f
    assert list(cli.as_lambda_type(spark, f, "BdyStem", "english").atoms()) == ["run", "dog"]
    assert list(cli.as_lambda_type(spark, f, "MtaSoundex").atoms()) == ["R552", "D200"]


def test_stream_of_pages(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    take = lambda: ingest(spark.readStream.schema("url string, html string").parquet(source), folder, f"file://{tmp_path}/check", lambda_type="MtaRaw").awaitTermination()
    spark.createDataFrame(PAGES[:2], "url string, html string").write.parquet(source)
    take()
    spark.createDataFrame([("http://b.com", '<title>Changed</title><a href="http://c.com/">again</a>'), PAGES[2]], "url string, html string").write.mode("append").parquet(source)
    take()
    links, labels = arrived(spark, folder)
    assert sorted(map(tuple, links.collect())) == [("http://a.com", "http://a.com"), ("http://a.com", "http://b.com"), ("http://b.com", "http://c.com")]
    assert sorted(r["formula"] for r in labels.filter("world = 'http://b.com'").collect()) == ["changed"]
