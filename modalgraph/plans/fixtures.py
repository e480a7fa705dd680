"""Graphs and labellings derived from the driver tables, as SQL for Spark and for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Graph
from ..sources.shared import dealt, saved

#: By name: (tables, SQL for both engines, or a pair of SQL texts where they differ).
FIXTURES: dict[str, tuple[list[str], str | tuple[str, str]]] = {
    "g1": (
        ["lineitem", "orders", "customer", "supplier", "nation"],
        """WITH e AS (SELECT n1.n_name AS source, n2.n_name AS target, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON c_custkey=o_custkey JOIN supplier ON s_suppkey=l_suppkey
  JOIN nation n1 ON n1.n_nationkey=c_nationkey JOIN nation n2 ON n2.n_nationkey=s_nationkey
  WHERE c_nationkey % 5 <> 0 GROUP BY n1.n_name, n2.n_name),
 m AS (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM e)
SELECT source, target FROM m WHERE r <= 3""",
    ),
    "g2": (
        ["nation"],
        """SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey
WHERE a.n_regionkey < 2 OR a.n_nationkey <= b.n_nationkey""",
    ),
    "g3": (
        ["events"],
        """SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(20))) AS source, concat('u', CAST(nxt AS VARCHAR(20))) AS target FROM
 (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type='error') x
WHERE nxt IS NOT NULL AND user_id % 7 <> 0""",
    ),
    "g4": (
        ["pages"],
        (
            r"""SELECT DISTINCT url AS source, concat(parse_url(url,'PROTOCOL'),'://',parse_url(url,'AUTHORITY'),h) AS target
FROM (SELECT url, explode(regexp_extract_all(html,r'<a href="([^"]*)"',1)) AS h FROM pages) t""",
            """SELECT DISTINCT url AS source, regexp_extract(url,'^(https?://[^/?#]+)',1) || h AS target
FROM (SELECT url, unnest(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS h FROM pages) t""",
        ),
    ),
    "l1": (
        ["lineitem", "part", "supplier", "nation"],
        """WITH e AS (SELECT n_name AS world, lower(p_brand) AS formula, 5 AS keep FROM lineitem JOIN part ON p_partkey=l_partkey
   JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey WHERE l_suppkey % 3 <> 1
  UNION ALL SELECT n_name, lower(p_type), 2 FROM lineitem JOIN part ON p_partkey=l_partkey
   JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey WHERE l_suppkey % 3 <> 1),
 g AS (SELECT world, formula, keep, count(*) AS frmcount FROM e GROUP BY world, formula, keep),
 r AS (SELECT world, formula, frmcount, keep, row_number() OVER (PARTITION BY world, keep ORDER BY frmcount DESC, formula) AS rk FROM g)
SELECT world, formula, frmcount FROM r WHERE rk <= keep""",
    ),
    "l2": (
        ["events"],
        """SELECT concat('u', CAST(user_id AS VARCHAR(20))) AS world,
       concat(event_type,'_',CAST(CAST(floor(value/50) AS INT) AS VARCHAR(10))) AS formula, count(*) AS frmcount
FROM events GROUP BY 1, 2""",
    ),
    "l3": (
        ["documents"],
        (
            r"""SELECT CAST(doc_id AS STRING) AS world, formula, count(*) AS frmcount FROM
 (SELECT doc_id, explode(split(lower(text), r'[^\p{L}]+')) AS formula FROM documents) t
WHERE length(formula) BETWEEN 2 AND 80 GROUP BY 1, 2""",
            r"""SELECT CAST(doc_id AS VARCHAR) AS world, formula, count(*) AS frmcount FROM
 (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS formula FROM documents) t
WHERE length(formula) BETWEEN 2 AND 80 GROUP BY 1, 2""",
        ),
    ),
}


class Data:
    """Tables and derived graphs of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return dealt(found) if name in ("documents", "pages") else found  # long texts, few rows

    def rows(self, name: str) -> DataFrame:
        """A fixture as a plan over the tables."""
        tables, sql = FIXTURES[name]
        for t in tables:
            self.table(t).createOrReplaceTempView(t)
        return self.spark.sql(sql if isinstance(sql, str) else sql[0])

    def kept(self, name: str) -> DataFrame:
        """A fixture as a stored table, for plans that use it many times."""
        return saved(self.rows(name), name)

    def graph(self, links: str, lam: str) -> Graph:
        return Graph(self.kept(links), self.kept(lam))

    def names(self, *worlds: str, column: str = "world") -> DataFrame:
        return self.spark.createDataFrame([(w,) for w in worlds], f"{column} string")


def oracle(fixtures: str, body: str) -> str:
    """SQL of the checking engine over named fixtures."""
    parts = []
    for name in fixtures.split():
        sql = FIXTURES[name][1]
        parts.append(f"{name} AS ({sql if isinstance(sql, str) else sql[1]})")
    return f"WITH RECURSIVE {', '.join(parts)} {body.strip()}" if not body.lstrip().startswith(",") else f"WITH RECURSIVE {', '.join(parts)}{body}"
