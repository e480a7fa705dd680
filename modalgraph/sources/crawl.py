"""Crawls over a corpus of links: what a spider of some depth would visit, found breadth first.

Going breadth first, a page is expanded at its least depth, so nothing within reach is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import without_last_slash
from .shared import saved


def crawl(links: DataFrame, start: str, depth: int = 1, by_host: bool = False) -> DataFrame:
    """(source, target) of the pages expanded from ``start`` down to a depth; an address with a last slash is the same page.

    ``by_host`` stays within the host of the start.
    """
    if depth < 1:
        raise ValueError("a crawl has a depth of at least 1")
    own = links if not by_host else links.filter(F.col("target").startswith(start.split("/", 3)[0] + "//" + start.split("/", 3)[2]))
    keyed = own.select(without_last_slash(F.col("source")).alias("key"), "source", "target")
    seen = links.sparkSession.createDataFrame([(start.rstrip("/"), 0)], "key string, depth int")
    for level in range(depth - 1):
        front = keyed.join(seen.filter(F.col("depth") == level), "key", "left_semi")
        new = front.select(without_last_slash(F.col("target")).alias("key")).distinct().join(seen, "key", "left_anti")
        seen = saved(seen.union(new.select("key", F.lit(level + 1).alias("depth"))), "visited")
    return keyed.join(seen, "key", "left_semi").select("source", "target").distinct()
