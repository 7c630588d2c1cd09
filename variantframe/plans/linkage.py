"""Queries on record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.operators import linkage

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def _tiers(d: str, tiers, beyond=None) -> str:
    more = f" WHEN {d} > {beyond[0]} THEN {beyond[1]}" if beyond else ""
    return f"CASE {' '.join(f'WHEN {d} <= {m} THEN {p}' for m, p in tiers)}{more} ELSE 0 END"


_D = {c: f"abs(r.{c} - l.{c})" for c in ("height", "weight", "age", "birth_year")}
BY_ID = f"""ids AS (SELECT left_id, right_id, score, criteria FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rn FROM (
  SELECT left_id, right_id, (100 + CASE WHEN abs(date_diff('day', l.day, r.day)) = 0 THEN 50 ELSE 30 - 5 * abs(date_diff('day', l.day, r.day)) END + {_tiers(_D['height'], linkage.ID_MEASURE, (2, -20))} + {_tiers(_D['weight'], linkage.ID_MEASURE, (2, -20))} + {_tiers(_D['age'], linkage.ID_AGE)})::INT AS score,
   'ID,DATE' || CASE WHEN {_D['height']} <= 2 THEN ',HEIGHT' ELSE '' END || CASE WHEN {_D['weight']} <= 2 THEN ',WEIGHT' ELSE '' END || CASE WHEN {_D['age']} <= 2 THEN ',AGE' ELSE '' END AS criteria
  FROM link_left l JOIN link_right r ON l.link_id = r.link_id WHERE abs(date_diff('day', l.day, r.day)) <= 5)) WHERE rn = 1)"""
BY_TRAITS = f"""traits AS (SELECT left_id, right_id, score, criteria FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rn FROM (
  SELECT left_id, right_id, (10 + {_tiers("date_diff('day', l.day, r.day)", linkage.TRAIT_DATE)} + {_tiers(_D['age'], linkage.TRAIT_AGE)} + {_tiers(_D['height'], linkage.TRAIT_MEASURE, (3, -10))} + {_tiers(_D['weight'], linkage.TRAIT_MEASURE, (3, -10))} + {_tiers(_D['birth_year'], linkage.TRAIT_BIRTH, (2, -15))})::INT AS score,
   'SEX,DATE' || CASE WHEN {_D['age']} <= 2 THEN ',AGE' ELSE '' END || CASE WHEN {_D['height']} <= 2 THEN ',HEIGHT' ELSE '' END || CASE WHEN {_D['weight']} <= 2 THEN ',WEIGHT' ELSE '' END || CASE WHEN {_D['birth_year']} <= 1 THEN ',BIRTH_YEAR' ELSE '' END AS criteria
  FROM link_left l JOIN link_right r ON l.sex = r.sex AND date_diff('day', l.day, r.day) BETWEEN 0 AND 5 WHERE coalesce({_D['age']} <= 3, true))) WHERE rn = 1 AND score > 0)"""
CHOSEN = """j AS (SELECT l.left_id, i.left_id IS NOT NULL AND (i.score >= 150 OR t.left_id IS NULL OR i.score >= t.score) AS a, i.right_id AS ir, i.score AS isc, i.criteria AS ic, t.right_id AS tr, t.score AS ts, t.criteria AS tc FROM link_left l LEFT JOIN ids i ON i.left_id = l.left_id LEFT JOIN traits t ON t.left_id = l.left_id),
k AS (SELECT left_id, CASE WHEN a THEN ir ELSE tr END AS right_id, coalesce(CASE WHEN a THEN isc ELSE ts END, 0) AS score, CASE WHEN a THEN ic ELSE tc END AS criteria, CASE WHEN a THEN 'ID' WHEN tr IS NOT NULL THEN 'TRAITS' ELSE 'NONE' END AS method FROM j),
c AS (SELECT *, CASE WHEN method = 'NONE' THEN 'NONE' WHEN method = 'ID' THEN CASE WHEN score >= 200 THEN 'EXACT_ID' WHEN score >= 150 THEN 'VERY_HIGH_ID' ELSE 'HIGH_ID' END
  WHEN contains(criteria, 'HEIGHT') AND contains(criteria, 'WEIGHT') THEN CASE WHEN score >= 100 THEN 'EXACT' WHEN score >= 80 THEN 'VERY_HIGH' WHEN score >= 60 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN score >= 70 THEN 'HIGH_UNMEASURED' WHEN score >= 50 THEN 'MEDIUM_UNMEASURED' ELSE 'LOW_UNMEASURED' END AS confidence FROM k)"""


@book.add("linkage_by_id", f"WITH {BY_ID} SELECT * FROM ids", "link_left link_right")
def _by_id(r):
    return linkage.link_by_id(r("link_left"), r("link_right"))


@book.add("linkage_by_traits", f"WITH {BY_TRAITS} SELECT * FROM traits", "link_left link_right")
def _by_traits(r):
    return linkage.link_by_traits(r("link_left"), r("link_right"))


def chosen(r):
    left, right = r("link_left"), r("link_right")
    return linkage.arbitrate(left, linkage.link_by_id(left, right), linkage.link_by_traits(left, right))


@book.add("linkage_best_match", f"WITH {BY_ID}, {BY_TRAITS}, {CHOSEN} SELECT left_id, right_id, score, criteria, method, confidence FROM c", "link_left link_right")
def _best(r):
    return chosen(r)


@book.add("linkage_stats", f"WITH {BY_ID}, {BY_TRAITS}, {CHOSEN} SELECT method, confidence, count(*) AS n, round(avg(score), 6) AS mean_score FROM c GROUP BY 1, 2", "link_left link_right")
def _stats(r):
    return rounded(chosen(r).groupBy("method", "confidence").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


@book.add("linkage_blocked_pairs", """SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rn FROM (SELECT c_custkey AS left_id, s_suppkey AS right_id,
  round(CASE WHEN abs(c_acctbal - s_acctbal) <= 500 THEN 1 - abs(c_acctbal - s_acctbal) / 500 ELSE 0 END, 6) AS score FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE score >= 0.5) WHERE rn = 1""")
def _blocked(r):
    l = r("customer").select(F.col("c_custkey").alias("left_id"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = r("supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    score = F.round(linkage.linear_points(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 1.0, 500.0), 6)
    return linkage.link_blocked(l, s, ["nation"], score, 0.5)


@book.add("linkage_all_pairs", """SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rn FROM (SELECT c_custkey AS left_id, s_suppkey AS right_id,
  round(CASE WHEN abs(c_acctbal - s_acctbal) <= 40 THEN 1 - abs(c_acctbal - s_acctbal) / 40 ELSE 0 END, 6) AS score FROM customer, supplier) WHERE score >= 0.5) WHERE rn = 1""")
def _all_pairs(r):
    l = r("customer").select(F.col("c_custkey").alias("left_id"), "c_acctbal")
    s = r("supplier").select(F.col("s_suppkey").alias("right_id"), "s_acctbal")
    score = F.round(linkage.linear_points(F.abs(F.col("c_acctbal") - F.col("s_acctbal")), 1.0, 40.0), 6)
    return linkage.link_near(l, s, "c_acctbal", "s_acctbal", 40.0, score, 0.5)


@book.add("attach_session", "SELECT l_orderkey, l_linenumber, l_partkey, o FROM lineitem LEFT JOIN (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY 1) s ON s.k = l_suppkey")
def _session(r):
    t = r("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("k"))
    s = r("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"))
    return linkage.attach_session(t, s, ["k"], "o").drop("k")
