"""Pages that arrive as a stream: their links and labels are appended to tables, each batch once.

What a crawler hands to a callback page by page comes here in micro-batches.  A batch writes to a folder of its own number, so a
batch that is tried again replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import host_links, labels, page_links, parsed
from ..sources.shared import saved


def ingest(pages: DataFrame, folder: str, checkpoint: str, within_hosts: bool = False, lambda_type: str = "BdyRaw") -> StreamingQuery:
    """Starts a query that takes what there is of a stream of pages (url, html); read the tables with ``arrived``."""

    def take(batch: DataFrame, number: int) -> None:
        found = saved(parsed(batch), "batch")
        links = page_links(found) if within_hosts else host_links(found)
        links.write.mode("overwrite").parquet(f"{folder}/links/batch={number}")
        labels(found, lambda_type).write.mode("overwrite").parquet(f"{folder}/lambda/batch={number}")

    return pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(links, labels) of all batches: each link once; of a page that came again, the labels of its last batch."""
    links = spark.read.option("basePath", f"{folder}/links").parquet(f"{folder}/links").select("source", "target").distinct()
    rows = spark.read.option("basePath", f"{folder}/lambda").parquet(f"{folder}/lambda")
    last = rows.groupBy("world").agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return links, rows.join(last, ["world", "batch"], "left_semi").select("world", "formula", "frmcount")
