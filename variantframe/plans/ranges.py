"""Queries on range joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.operators import ranges

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
NEAR = """WITH x AS (SELECT p.point_id, CASE WHEN p.pos < b THEN b - p.pos WHEN p.pos >= e THEN p.pos - e + 1 ELSE 0 END AS d FROM points p JOIN intervals i ON p.CHROM = i.CHROM),
  n AS (SELECT point_id, min(d) AS d FROM x GROUP BY point_id) SELECT p.point_id, {0} AS distance FROM points p LEFT JOIN n ON n.point_id = p.point_id"""


@book.add("range_overlap", "SELECT point_id, iv FROM points p JOIN intervals i ON p.CHROM = i.CHROM AND p.pos >= b AND p.pos < e")
def _overlap(r):
    return ranges.overlaps(r("points"), r("intervals"), "point_id", "iv", begin="b", end="e")


@book.add("nearest_interval", NEAR.format("d"), "points intervals")
def _nearest(r):
    p = r("points")
    near = ranges.nearest_interval(p, r("intervals"), "iv", begin="b", end="e", segment=20_000)
    return p.select("point_id").join(near, "point_id", "left").select("point_id", "distance")


@book.add("nearest_within_limit", NEAR.format("CASE WHEN d <= 500 THEN d END"), "points intervals")
def _limited(r):
    p = r("points")
    near = ranges.nearest_interval(p, r("intervals"), "iv", begin="b", end="e", limit=500)
    return p.select("point_id").join(near, "point_id", "left").select("point_id", "distance")


@book.add("gap_clusters", """WITH f AS (SELECT CHROM, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY CHROM ORDER BY pos) <= 10 THEN 0 ELSE 1 END AS s FROM points), c AS (SELECT CHROM, pos, sum(s) OVER (PARTITION BY CHROM ORDER BY pos RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster FROM f)
  SELECT CHROM, cluster, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM c GROUP BY 1, 2""", "points")
def _clusters(r):
    c = ranges.gap_clusters(r("points"), ["CHROM"], "pos", 10)
    return c.groupBy("CHROM", "cluster").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


@book.add("asof_interpolate", """WITH g AS (SELECT CHROM, b AS x, min(e) AS y FROM intervals GROUP BY 1, 2), l AS (SELECT p.point_id, g.x AS x1, g.y AS y1 FROM points p ASOF LEFT JOIN g ON p.CHROM = g.CHROM AND p.pos >= g.x),
  h AS (SELECT p.point_id, g.x AS x2, g.y AS y2 FROM points p ASOF LEFT JOIN g ON p.CHROM = g.CHROM AND p.pos <= g.x)
  SELECT p.point_id, round(CASE WHEN x1 IS NULL THEN y2 WHEN x2 IS NULL OR x1 = pos THEN y1 ELSE y1 + (pos - x1)::DOUBLE / (x2 - x1) * (y2 - y1) END, 6) AS y FROM points p JOIN l USING (point_id) JOIN h USING (point_id)""", "points intervals")
def _interpolate(r):
    return rounded(ranges.interpolate(r("points"), r("intervals").select("CHROM", F.col("b").alias("x"), F.col("e").alias("y")), ["CHROM"]))
