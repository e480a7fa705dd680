"""The store: links, labels by type, languages and ranks as Parquet tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import url_domain
from ..model import LAMBDA_TYPES, Graph
from ..operators.tfidf import scored
from ..operators.traverse import pagerank
from .pages import folded, host_links, labels, page_language, page_links, parsed
from .shared import saved

SCHEMAS = {
    "links": "source string, target string",
    "lambda": "world string, formula string, frmcount bigint, tfidf double, lambda_type string",
    "world_stem_lang": "world string, language string",
    "pagerank": "world string, score double",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A table, empty if it was never written."""
        path = f"{self.folder}/{name}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if there else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame, by: str | None = None) -> None:
        """Replaces a table; rows that come from it are kept aside first."""
        kept = saved(rows.select(*(c.split()[0] for c in SCHEMAS[name].split(", "))), name)
        writer = kept.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{name}")

    def add_links(self, links: DataFrame) -> None:
        """Adds links; those that are there already are no error."""
        self.write("links", self.table("links").union(links.select("source", "target")).distinct())

    def add_pages(self, pages: DataFrame, within_hosts: bool = False) -> None:
        """Links of pages (url, html): between hosts, or between pages of one host."""
        found = parsed(pages)
        self.add_links(page_links(found) if within_hosts else host_links(found))

    def build_labels(self, pages: DataFrame) -> None:
        """Labels of all types and the languages of pages, from their HTML."""
        found = saved(parsed(pages), "parsed")
        rows = None
        for kind in LAMBDA_TYPES:
            own = labels(found, kind).select("world", "formula", "frmcount", F.lit(None).cast("double").alias("tfidf"), F.lit(kind).alias("lambda_type"))
            rows = own if rows is None else rows.union(own)
        self.write("lambda", rows, "lambda_type")
        self.write("world_stem_lang", page_language(found))

    def fold_labels(self) -> None:
        """Adds the labels of pages to those of their domains; pages that are not their domain go, from languages too.

        Scores have to be computed anew.
        """
        rows = None
        for kind in LAMBDA_TYPES:
            own = folded(self.labels(kind)).select("world", "formula", "frmcount", F.lit(None).cast("double").alias("tfidf"), F.lit(kind).alias("lambda_type"))
            rows = own if rows is None else rows.union(own)
        self.write("lambda", rows, "lambda_type")
        domain = url_domain(F.col("world"))
        self.write("world_stem_lang", self.table("world_stem_lang").filter((domain == "") | (domain == F.col("world"))))

    def score_labels(self) -> None:
        """Tf-idf of all labels, by type."""
        rows = None
        for kind in LAMBDA_TYPES:
            own = scored(self.labels(kind)).withColumn("lambda_type", F.lit(kind))
            rows = own if rows is None else rows.union(own)
        self.write("lambda", rows, "lambda_type")

    def rank_links(self, sweeps: int = 10) -> None:
        self.write("pagerank", pagerank(self.table("links"), sweeps))

    def labels(self, kind: str) -> DataFrame:
        return self.table("lambda").filter(F.col("lambda_type") == kind)

    def graph(self, kind: str = "BdyRaw") -> Graph:
        return Graph(self.table("links"), self.labels(kind))

    def stored_scores(self, kind: str, world: str) -> DataFrame:
        """(formula, tfidf) of a world, highest first; an error if scores were not computed."""
        own = self.labels(kind).filter(F.col("world") == world)
        if own.filter("tfidf is null").limit(1).count():
            raise ValueError("scores are not computed: call score_labels() first")
        return own.select("formula", "tfidf").orderBy(F.col("tfidf").desc_nulls_first(), "formula")
