"""Command line over a store: ``python -m modalgraph.cli --store FOLDER [--pages TABLE] OPTIONS``.

All options given are carried out, in the order listed by ``--help``, whatever their order on the command line.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.formula import Formula, parse
from .functions.snowball import STEMMERS, stem
from .functions.terms import soundex_code
from .model import LAMBDA_TYPES
from .operators import lookup, modal, rough, tfidf, traverse
from .sources.crawl import crawl
from .sources.pages import host_links, page_links, parsed
from .sources.shared import saved
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modalgraph", description="Builds and queries labelled graphs of web pages.")
    add = p.add_argument
    add("--store", required=True, metavar="FOLDER", help="folder of the tables")
    add("--pages", metavar="TABLE", help="Parquet table of pages (url, html) that stands for the web")
    add("-R", "--accrel", metavar="URL", help="crawl from an address and add links between hosts")
    add("--relaccrel", metavar="URL", help="crawl within a host and add links between its pages")
    add("-d", "--depth", type=int, default=1, metavar="N", help="depth of a crawl (1)")
    add("-l", "--lamrel", action="store_true", help="build the labels of all pages in links")
    add("--foldlambda", action="store_true", help="add the labels of pages to those of their domains")
    add("--tfidfcalc", action="store_true", help="compute and store the scores of all labels")
    add("-p", "--pagerankcalc", type=int, nargs="?", const=10, metavar="N", help="compute and store ranks in so many sweeps (10)")
    add("--lambdatype", choices=LAMBDA_TYPES, default="BdyRaw", help="labels that the following are about (BdyRaw)")
    add("--lamaccum", action="store_true", help="counts and shares of all formulas")
    add("-t", "--tfidf", metavar="URL", help="formulas of a world by score, lowest first")
    add("-g", "--tfidfsearch", metavar="FORMULA", help="worlds with a formula by score, highest first")
    add("-f", "--plformula", metavar="FORMULA", help="worlds that satisfy a propositional formula")
    add("--pmlformula", metavar="FORMULA", help="worlds that satisfy a modal formula")
    add("--inlinkrings", metavar="URL", help="rings of worlds around a world, against the links")
    add("--outlinkrings", metavar="URL", help="rings of worlds around a world, along the links")
    add("--rsetlampl", metavar="FORMULA", help="rough set of a propositional formula")
    add("--rsetlamlist", metavar="WORDS", help="rough set of a list of formulas")
    add("--rsetworldlam", metavar="WORLD", help="rough set of a world's formulas")
    add("--rsetilinklist", metavar="WORLDS", help="rough set of a list of linking worlds")
    add("--rsetworldsils", metavar="WORLD", help="rough set of the worlds linking to a world")
    add("--rsetolinklist", metavar="WORLDS", help="rough set of a list of linked worlds")
    add("--rsetworldsols", metavar="WORLD", help="rough set of the worlds a world links to")
    return p


def as_lambda_type(spark: SparkSession, formula: Formula, kind: str, language: str | None = None) -> Formula:
    """A formula whose atoms are in the form of a lambda type: stems need a language, sound codes do not."""
    if kind.endswith("Stem"):
        return formula.mapped(lambda a: stem(a, language))
    if kind.endswith("Soundex"):
        atoms = sorted(formula.atoms())
        found = spark.createDataFrame([(a,) for a in atoms], "a string").select("a", F.coalesce(soundex_code(F.col("a")), "a").alias("c")).collect()
        codes = {r["a"]: r["c"] for r in found}
        return formula.mapped(codes.__getitem__)
    return formula


def run(spark: SparkSession, argv: Sequence[str]) -> list[tuple[str, DataFrame]]:
    """Carries out the options; returns (option, rows) of those that ask something."""
    o = parser().parse_args(argv)
    store, out = Store(spark, o.store), []
    pages = spark.read.parquet(o.pages) if o.pages else None
    if (o.accrel or o.relaccrel or o.lamrel) and pages is None:
        raise SystemExit("crawls and labels need --pages")
    for start, within in ((o.accrel, False), (o.relaccrel, True)):
        if start:
            html = parsed(pages)
            if within:
                store.add_links(crawl(saved(page_links(html), "links"), start, o.depth, by_host=True))
            else:
                store.add_links(crawl(saved(host_links(html), "links"), start, o.depth))
    if o.lamrel:
        worlds = saved(lookup.worlds_in_links(store.table("links")), "worlds")
        store.build_labels(pages.join(worlds.withColumnRenamed("world", "url"), "url", "left_semi"))
    if o.foldlambda:
        store.fold_labels()
    if o.tfidfcalc:
        store.score_labels()
    if o.pagerankcalc is not None:
        store.rank_links(o.pagerankcalc)
    kind = o.lambdatype
    graph = store.graph(kind)
    links, lam = graph.links, graph.lam
    # stems depend on each world's language, so atoms are asked for in all of them
    stems = partial(lookup.holding, lam, form=stem, languages=store.table("world_stem_lang"), stem_languages=sorted(STEMMERS)) if kind.endswith("Stem") else None
    form = lambda text, modal_too: parse(text, modal_too) if stems else as_lambda_type(spark, parse(text, modal_too), kind)
    asked = {
        "lamaccum": lambda _: lookup.accumulated(lam).orderBy(F.desc("total"), "formula"),
        "tfidf": lambda w: tfidf.of_world(lam, w).orderBy("tfidf", "formula"),
        "tfidfsearch": lambda f: tfidf.search(lam, f, stems([f]) if stems else None).orderBy(F.desc("tfidf"), "world"),
        "plformula": lambda f: modal.satisfying(graph, form(f, False), held_in=stems).orderBy("world"),
        "pmlformula": lambda f: modal.satisfying(graph, form(f, True), held_in=stems).orderBy("world"),
        "inlinkrings": lambda w: traverse.link_rings(links, w, outward=False).orderBy("ring", "world"),
        "outlinkrings": lambda w: traverse.link_rings(links, w).orderBy("ring", "world"),
        "rsetlampl": lambda f: rough.of_formula(lam, parse(f, modal=False)).orderBy("world"),
        "rsetlamlist": lambda ws: rough.of_items(lam, "world", "formula", ws.split()).orderBy("world"),
        "rsetworldlam": lambda w: rough.of_neighbour(lam, "world", "formula", w).orderBy("world"),
        "rsetilinklist": lambda ws: rough.of_items(links, "target", "source", ws.split()).orderBy("world"),
        "rsetworldsils": lambda w: rough.of_neighbour(links, "target", "source", w).orderBy("world"),
        "rsetolinklist": lambda ws: rough.of_items(links, "source", "target", ws.split()).orderBy("world"),
        "rsetworldsols": lambda w: rough.of_neighbour(links, "source", "target", w).orderBy("world"),
    }
    for name, query in asked.items():
        if value := getattr(o, name):
            out.append((name, query(value)))
    return out


def shown(name: str, rows: DataFrame) -> list[str]:
    """Lines of a result: rings as columns of text, other rows tab-separated."""
    if name.endswith("rings"):
        rings: dict[int, list[str]] = {}
        for r in rows.collect():
            rings.setdefault(r["ring"], []).append(r["world"])
        return traverse.ring_columns([rings[k] for k in sorted(rings)])
    return ["\t".join(map(str, r)) for r in rows.toLocalIterator()]


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("modalgraph").getOrCreate()
    for name, rows in run(spark, sys.argv[1:]):
        print(f"# {name}")
        for line in shown(name, rows):
            print(line)


if __name__ == "__main__":
    main()
