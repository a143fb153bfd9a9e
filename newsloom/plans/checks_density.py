"""Checks: neighbours, core distances, spanning tree, density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import density as D
from newsloom.plans.registry import check

PAIRS_SQL = """
WITH pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS place
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
"""


@check("nearest_neighbours", "", PAIRS_SQL + "SELECT id, place, other, round(d, 6) AS distance FROM pairs WHERE place <= 3")
def nearest_neighbours(v):
    rows = D.nearest(v.vectors(), 3).select("id", F.posexplode("nearest").alias("pos", "n"))
    return rows.select(
        "id", (F.col("pos") + 1).alias("place"), F.col("n.id").alias("other"), F.round("n.distance", 6).alias("distance")
    )


@check("approximate_neighbours", "", "SELECT count(*) AS points, count(*) * 3 AS neighbours, true AS recalled FROM embeddings")
def approximate_neighbours(v):
    """Share of the three exact neighbours that the approximate form finds: 0.9 and more."""
    def pairs(df):
        return df.select("id", F.explode("nearest.id").alias("other"))

    exact = pairs(D.nearest(v.vectors(), 3))
    met = pairs(D.approximate_nearest(v.vectors(), 3, tables=16, bits=3)).withColumn("met", F.lit(1))
    counted = exact.join(met, ["id", "other"], "left").agg(
        F.countDistinct("id").alias("points"), F.count("*").alias("neighbours"), (F.count("met") / F.count("*") >= 0.9).alias("recalled")
    )
    return counted


@check("core_distance", "", PAIRS_SQL + "SELECT id, round(d, 6) AS core FROM pairs WHERE place = 2")
def core_distance(v):
    return D.core_distance(v.vectors()).select("id", F.round("core", 6).alias("core"))


@check("mutual_reachability_mst")
def mutual_reachability_mst(v):
    """Spanning tree; equal to brute force in the tests, not a SQL query."""
    tree = D.mutual_reachability_mst(v.vectors())
    return tree.select("i", "j", F.round("w", 6).alias("w"))


# Leaf clusters without merging (the driver vectors lie far apart): trees of lightest edges, less
# the points that join after the tree's lightest outgoing edge.
HDBSCAN_SQL = "WITH RECURSIVE " + PAIRS_SQL.strip().removeprefix("WITH ") + """
, core AS (SELECT id, d AS core FROM pairs WHERE place = 2),
edges AS MATERIALIZED (
  SELECT p.id AS i, p.other AS j, {'w': greatest(a.core, b.core, p.d), 'i': p.id, 'j': p.other} AS e
  FROM pairs p JOIN core a ON a.id = p.id JOIN core b ON b.id = p.other WHERE p.id < p.other),
ends AS MATERIALIZED (SELECT i AS id, j AS other, e FROM edges UNION ALL SELECT j, i, e FROM edges),
first AS MATERIALIZED (SELECT id, min(e) AS e FROM ends GROUP BY id),
links AS MATERIALIZED (SELECT e.i AS x, e.j AS y FROM first UNION SELECT e.j, e.i FROM first),
reach AS (SELECT id, id AS r FROM first UNION SELECT reach.id, links.y FROM reach JOIN links ON links.x = reach.r),
seed AS MATERIALIZED (SELECT id, min(r) AS g FROM reach GROUP BY id),
closing AS (SELECT s.g, min(n.e) AS e FROM ends n JOIN seed s ON s.id = n.id JOIN seed o ON o.id = n.other
            WHERE s.g <> o.g GROUP BY s.g),
inside AS (SELECT f.id, s.g FROM first f JOIN seed s ON s.id = f.id JOIN closing c ON c.g = s.g WHERE f.e < c.e)
SELECT f.id, CASE WHEN i.id IS NULL THEN -1 ELSE min(i.id) OVER (PARTITION BY i.g) END AS label
FROM first f LEFT JOIN inside i ON i.id = f.id"""


@check("hdbscan", "", HDBSCAN_SQL)
def hdbscan(v):
    """Leaf clusters at the default merge distance."""
    return D.hdbscan(v.vectors()).select("id", "label")


@check("hdbscan_by_day", "articles", """
SELECT strftime(published_at, '%Y-%m-%d') AS day, count(*) AS points FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1""")
def hdbscan_by_day(v):
    """Every day as its own run, clustered side by side; SQL can state that no article is lost."""
    points = v.articles_with_vectors().select(F.date_format("published_at", "yyyy-MM-dd").alias("run_key"), "id", "embedding")
    out = D.hdbscan(points, epsilon=1.1)
    return out.groupBy(F.col("run_key").alias("day")).agg(F.count("label").alias("points"))


@check("cluster_articles")
def cluster_articles(v):
    """Window clusters with every article in exactly one of them."""
    return D.cluster_articles(v.articles_with_vectors(), epsilon=1.1).select("id", "label")
