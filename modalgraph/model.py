"""A labelled graph: links between worlds and, for each world, the formulas that hold there.

Three domains of worlds are in play: both ends of links, the sources of links, and the worlds that have formulas.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDA_TYPES = ("MtaRaw", "MtaStem", "MtaSoundex", "BdyRaw", "BdyStem", "BdySoundex")


def nodes(links: DataFrame) -> DataFrame:
    """(world): both ends of links."""
    return links.select(F.explode(F.array("source", "target")).alias("world")).distinct()


@dataclass(frozen=True)
class Graph:
    """``links`` (source, target) without repeats; ``lam`` (world, formula, frmcount) with one row for each world and formula."""

    links: DataFrame
    lam: DataFrame
    #: The worlds of a frame, where they are given and not read off the links.
    worlds: DataFrame | None = None

    @property
    def linked(self) -> DataFrame:
        return self.worlds if self.worlds is not None else nodes(self.links)

    @property
    def sources(self) -> DataFrame:
        return self.links.select(F.col("source").alias("world")).distinct()

    @property
    def labelled(self) -> DataFrame:
        return self.lam.select("world").distinct()

    @property
    def everywhere(self) -> DataFrame:
        return self.linked.union(self.labelled).distinct()

    def unreflexive(self) -> Graph:
        """Without links from a world to itself; its worlds stay."""
        return replace(self, links=self.links.filter("source <> target"), worlds=self.linked)

    def reduced(self, worlds: DataFrame) -> Graph:
        """The part within ``worlds`` (world), which become its worlds as they are."""
        inside = self.links.join(worlds.withColumnRenamed("world", "source"), "source", "left_semi").join(worlds.withColumnRenamed("world", "target"), "target", "left_semi")
        return Graph(inside.select("source", "target"), self.lam.join(worlds, "world", "left_semi"), worlds)
