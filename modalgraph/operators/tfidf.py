"""Tf-idf scores of formulas in worlds: count * log10(worlds / worlds with the formula)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scored(lam: DataFrame) -> DataFrame:
    """(world, formula, frmcount, tfidf) for all worlds: one count of worlds for each formula and one for all."""
    df = lam.groupBy("formula").agg(F.count(F.lit(1)).alias("df"))
    n = lam.agg(F.countDistinct("world").alias("n"))
    return lam.join(df, "formula").join(F.broadcast(n)).select("world", "formula", "frmcount", (F.col("frmcount") * F.log10(F.col("n") / F.col("df"))).alias("tfidf"))  # n is one row


def score_of(lam: DataFrame, world: str, formula: str) -> DataFrame:
    """One row: the score of a formula in a world, 0 where it holds nowhere."""
    tf = F.coalesce(F.max(F.when((F.col("world") == world) & (F.col("formula") == formula), F.col("frmcount"))), F.lit(0))
    df = F.count_if(F.col("formula") == formula)
    return lam.agg(F.when(df == 0, 0.0).otherwise(tf * F.log10(F.countDistinct("world") / F.when(df == 0, 1).otherwise(df))).alias("tfidf"))


def of_world(lam: DataFrame, world: str) -> DataFrame:
    """(formula, tfidf) of a world; only formulas of the world are counted elsewhere."""
    own = lam.filter(F.col("world") == world)
    near = lam.join(own.select("formula"), "formula", "left_semi").groupBy("formula").agg(F.count(F.lit(1)).alias("df"))
    n = lam.agg(F.countDistinct("world").alias("n"))
    return own.join(near, "formula").join(F.broadcast(n)).select("formula", (F.col("frmcount") * F.log10(F.col("n") / F.col("df"))).alias("tfidf"))


def _descending() -> list[Column]:
    return [F.col("tfidf").desc_nulls_first(), F.col("formula")]


def top_n(scores: DataFrame, n: int) -> DataFrame:
    """The n formulas of each world with the highest scores, ties by name."""
    rank = F.row_number().over(Window.partitionBy("world").orderBy(*_descending()))
    return scores.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n)


def dropped(count: Column, percent: int) -> Column:
    """How many of so many items a cut of so many percent drops; halves go to the even number."""
    return F.bround(count * F.lit(percent / 100), 0)


def top_percent(scores: DataFrame, percent: int) -> DataFrame:
    """The first so many percent of each world's formulas by score."""
    many = F.count(F.lit(1)).over(Window.partitionBy("world"))
    rank = F.row_number().over(Window.partitionBy("world").orderBy(*_descending()))
    return scores.select("*", rank.cast("bigint").alias("rank"), many.alias("many")).filter(F.col("rank") <= F.col("many") - dropped(F.col("many"), 100 - percent)).drop("many")


def cut_percent(scores: DataFrame, percent: int) -> DataFrame:
    """Without the first so many percent of each world's formulas, then without the last so many of those left."""
    many = F.count(F.lit(1)).over(Window.partitionBy("world"))
    rank = F.row_number().over(Window.partitionBy("world").orderBy(*_descending()))
    head = dropped(F.col("many"), percent)
    tail = dropped(F.col("many") - head, percent)
    return scores.select("*", rank.cast("bigint").alias("rank"), many.alias("many")).filter((F.col("rank") > head) & (F.col("rank") <= F.col("many") - tail)).drop("many")


def search(lam: DataFrame, formula: str, here: DataFrame | None = None) -> DataFrame:
    """(world, tfidf) of the worlds with a formula, or of those given (world, frmcount), where it has another form in each."""
    here = lam.filter(F.col("formula") == formula).select("world", "frmcount") if here is None else here
    return here.join(F.broadcast(here.agg(F.count(F.lit(1)).alias("df"))).join(F.broadcast(lam.agg(F.countDistinct("world").alias("n"))))).select("world", (F.col("frmcount") * F.log10(F.col("n") / F.col("df"))).alias("tfidf"))
