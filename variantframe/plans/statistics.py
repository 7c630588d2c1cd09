"""Queries on summaries, windows, rankings and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.operators import ranking, statistics, windows
from variantframe.operators.common import first_per

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

NINE = "count(*) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS sd, round(min({0}), 6) AS min, round(max({0}), 6) AS max, " + ", ".join(f"round(quantile_cont({{0}}, {q}), 6) AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))
CATEGORY = """CASE WHEN consequence IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant', 'splice_acceptor_variant', 'start_lost', 'stop_lost') THEN 'pLoF'
  WHEN consequence IN ('missense_variant', 'inframe_insertion', 'inframe_deletion') THEN 'missense' WHEN consequence IN ('synonymous_variant', 'coding_sequence_variant') THEN 'synonymous'
  WHEN consequence IN ('splice_site_variant', 'splice_region_variant') THEN 'splice_region' ELSE 'non_coding' END"""
CSQ = "CASE consequence WHEN 'stop_gained' THEN 1.0 WHEN 'missense_variant' THEN 0.7 WHEN 'inframe_deletion' THEN 0.65 WHEN 'splice_region_variant' THEN 0.55 WHEN 'synonymous_variant' THEN 0.2 WHEN 'intron_variant' THEN 0.05 WHEN 'upstream_gene_variant' THEN 0.03 ELSE 0.01 END::DOUBLE"
RARE = "CASE rarity_class WHEN 'ultra_rare' THEN 1.0 WHEN 'novel' THEN 0.9 WHEN 'rare' THEN 0.75 WHEN 'low_frequency' THEN 0.5 WHEN 'common' THEN 0.0 ELSE 0.5 END::DOUBLE"
CADD = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(TRY_CAST(cadd_phred AS DOUBLE), 0) / 50))"
PLAIN = f"round(0.25::DOUBLE * {RARE} + 0.3::DOUBLE * {CSQ} + 0.2::DOUBLE * {CADD} + 0.1::DOUBLE * least(1.0::DOUBLE, revel_score) + 0.05::DOUBLE * is_lof::INT::DOUBLE, 4)"
RANKED = f"ranked AS (SELECT *, {PLAIN} AS rank_score FROM annotated)"
ROW = ("PRS_ID", "CHROM", "POS", "l_orderkey", "l_linenumber", "BETA")


def ranked(r):
    return ranking.ranking_score(r("annotated"), None, regulatory=False)


@book.add("score_summary_stats", f"SELECT {NINE.format('raw')} FROM scores")
def _summary(r):
    return rounded(statistics.summary(r("scores"), "raw"))


@book.add("five_number_by_category", f"SELECT category, {NINE.format('cadd')} FROM (SELECT *, {CATEGORY} AS category FROM annotated) WHERE cadd IS NOT NULL GROUP BY category", "annotated")
def _by_category(r):
    return rounded(statistics.summary(r("annotated").withColumn("category", ranking.category(F.col("consequence"))), "cadd", ["category"]))


@book.add("abs_effect_by_region", f"SELECT category, round(sum(abs(BETA)), 5) AS sum_abs_beta FROM (SELECT *, {CATEGORY} AS category FROM annotated) GROUP BY category", "annotated")
def _abs(r):
    return r("annotated").groupBy(ranking.category(F.col("consequence")).alias("category")).agg(F.round(F.sum(F.abs("BETA")), 5).alias("sum_abs_beta"))


@book.add("histogram_50", """WITH m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM scores), b AS (SELECT least(floor((raw - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM scores, m GROUP BY 1)
  SELECT k::INT AS bin, round(lo + k * ((hi - lo) / 50), 6) AS lower, coalesce(n, 0) AS n FROM range(50) t(k) CROSS JOIN m LEFT JOIN b ON b.bin = k""", "scores")
def _histogram(r):
    return rounded(statistics.histogram(r("scores"), "raw"))


@book.add("stacked_bins_25", """WITH m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM scores), b AS (SELECT least(floor((raw - lo) / ((hi - lo) / 25)), 24)::INT AS bin, sex, raw FROM scores, m)
  SELECT k::INT AS bin, count(*) FILTER (WHERE sex = 0) AS "0", count(*) FILTER (WHERE sex = 1) AS "1", round(avg(raw), 6) AS mean FROM range(25) t(k) LEFT JOIN b ON b.bin = k GROUP BY k""", "scores")
def _stacked(r):
    return rounded(statistics.stacked_bins(r("scores").withColumn("sex", F.col("sex").cast("string")), "raw", "sex", ["0", "1"]))


@book.add("af_log_spectrum", "SELECT round(floor(log10(af) * 10 + 0.5) / 10, 6) AS log_af, rarity_class, count(*) AS n FROM annotated WHERE af > 0 GROUP BY 1, 2")
def _spectrum(r):
    return rounded(statistics.log_spectrum(r("annotated"), "af", "rarity_class"))


@book.add("manhattan_1mb_bins", "SELECT CHROM, CAST(floor(POS / 1000000) AS BIGINT) AS bin, count(*) AS n, min(POS) AS min_pos, max(POS) AS max_pos, round(max(abs(BETA)), 6) AS max_abs_beta, round(sum(abs(BETA)), 5) AS sum_abs_beta, arg_max(consequence, {'a': abs(BETA), 'b': consequence, 'c': POS}) AS top_consequence FROM annotated GROUP BY 1, 2")
def _bins(r):
    return rounded(statistics.megabase_bins(r("annotated")).withColumn("sum_abs_beta", F.round("sum_abs_beta", 5)))


@book.add("cumulative_beta_curve", """SELECT rank, round(run / total, 6) AS share FROM (SELECT row_number() OVER w AS rank, sum(abs(raw)) OVER (ORDER BY abs(raw) DESC, sample_id ROWS UNBOUNDED PRECEDING) AS run, sum(abs(raw)) OVER () AS total FROM scores WINDOW w AS (ORDER BY abs(raw) DESC, sample_id))
  WHERE rank IN (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000)""", "scores")
def _curve(r):
    return rounded(windows.cumulative_share(r("scores"), "raw", "sample_id", [1, 2, 5, 10, 20, 50, 100, 200, 500, 1000]))


@book.add("cumulative_offset", """WITH m AS (SELECT CHROM, max(pos) AS top, min(pos) AS low FROM points GROUP BY CHROM), o AS (SELECT *, coalesce(sum(top + 5000000) OVER (ORDER BY CHROM ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM m)
  SELECT CHROM, o AS "offset", o + (low + top) / 2 AS center FROM o""", "points")
def _offset(r):
    return windows.genome_offsets(r("points"), "CHROM", "pos")


@book.add("genome_coordinates", """WITH m AS (SELECT CHROM, max(pos) AS top FROM points GROUP BY CHROM), o AS (SELECT CHROM, coalesce(sum(top + 5000000) OVER (ORDER BY CHROM ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM m) SELECT point_id, p.CHROM, pos, pos + o AS genome_pos FROM points p JOIN o ON o.CHROM = p.CHROM""", "points")
def _coordinates(r):
    return windows.genome_coordinates(r("points"), "CHROM", "pos")


@book.add("percentile_rank_avg_ties", "SELECT sample_id, round(100 * (rank() OVER (ORDER BY prs) + (count(*) OVER (PARTITION BY prs) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS percentile FROM scores")
def _percentile(r):
    return rounded(windows.percentile_rank(r("scores"), "prs").select("sample_id", "percentile"))


@book.add("integer_percentile", "SELECT sample_id, CAST(round_even(least(greatest(100 * (rank() OVER (ORDER BY prs) + (count(*) OVER (PARTITION BY prs) - 1) / 2.0::DOUBLE) / count(*) OVER (), 1), 100), 0) AS INT) AS percentile FROM scores")
def _integer(r):
    return windows.integer_percentile(r("scores"), "prs").select("sample_id", "percentile")


@book.add("zscore_by_group", "SELECT sample_id, sex, round((raw - avg(raw) OVER (PARTITION BY sex)) / stddev_samp(raw) OVER (PARTITION BY sex), 6) AS z FROM scores")
def _zscore(r):
    return rounded(windows.zscore(r("scores"), "raw", "z", ["sex"]).select("sample_id", "sex", "z"))


@book.add("decile_ntile", "SELECT sample_id, CAST(ntile(10) OVER (ORDER BY raw, sample_id) AS INT) AS decile FROM scores")
def _ntile(r):
    return windows.ntile(r("scores"), "raw", "sample_id").select("sample_id", "decile")


EDGES = "1 + " + " + ".join(f"(prs > (SELECT quantile_cont(prs, {i / 10}) FROM scores))::INT" for i in range(1, 10))


@book.add("decile_quantile_edges", f"SELECT sample_id, ({EDGES})::INT AS decile FROM scores")
def _edges(r):
    return windows.quantile_groups(r("scores"), "prs").select("sample_id", "decile")


@book.add("decile_odds_ratio", """WITH d AS (SELECT ntile(10) OVER (ORDER BY raw, sample_id)::INT AS decile, status FROM scores), t AS (SELECT decile, count(*) AS n, sum(status)::BIGINT AS cases FROM d GROUP BY decile),
  j AS (SELECT t.*, (SELECT cases FROM t WHERE decile = 5)::DOUBLE AS c, (SELECT n - cases FROM t WHERE decile = 5)::DOUBLE AS e FROM t)
  SELECT decile, n, cases, round(100.0 * cases / n, 6) AS percent, round(cases * e / ((n - cases) * c), 6) AS odds_ratio,
   round(exp(ln(cases * e / ((n - cases) * c)) - 1.96 * sqrt(1.0 / cases + 1.0 / (n - cases) + 1 / c + 1 / e)), 6) AS ci_low, round(exp(ln(cases * e / ((n - cases) * c)) + 1.96 * sqrt(1.0 / cases + 1.0 / (n - cases) + 1 / c + 1 / e)), 6) AS ci_high FROM j""", "scores")
def _odds(r):
    return rounded(statistics.decile_odds(windows.ntile(r("scores"), "raw", "sample_id"), "decile", "status"))


@book.add("prevalence_by_decile", "SELECT decile, count(*) AS n, round(avg(status::DOUBLE), 9) AS observed, round(avg(raw), 9) AS predicted FROM (SELECT ntile(10) OVER (ORDER BY raw, sample_id)::INT AS decile, status, raw FROM scores) GROUP BY decile", "scores")
def _prevalence(r):
    return rounded(statistics.prevalence(windows.ntile(r("scores"), "raw", "sample_id"), "decile", "status", "raw"), 9)


@book.add("pairwise_agreement", """WITH x AS (SELECT prs AS a, raw AS b, rank() OVER (ORDER BY prs) + (count(*) OVER (PARTITION BY prs) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2.0::DOUBLE AS rb FROM scores)
  SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 6) AS mae, round(max(abs(a - b)), 6) AS max_diff, round(quantile_cont(abs(a - b), 0.5), 6) AS median_diff, round(quantile_cont(abs(a - b), 0.95), 6) AS p95_diff,
   round(avg((abs(a - b) <= 10)::INT::DOUBLE), 6) AS within_10, round(avg((abs(a - b) <= 25)::INT::DOUBLE), 6) AS within_25 FROM x""", "scores")
def _agreement(r):
    return rounded(statistics.agreement(r("scores"), "prs", "raw", (10, 25)))


@book.add("sd_coverage", "WITH m AS (SELECT avg(raw) AS m, stddev_samp(raw) AS s FROM scores) SELECT k::INT AS k, round(avg((abs(raw - m) <= k * s)::INT::DOUBLE), 6) AS share FROM scores, m, (VALUES (1), (2), (3)) t(k) GROUP BY k", "scores")
def _coverage(r):
    return rounded(statistics.coverage(r("scores"), "raw"))


@book.add("roc_auc", "WITH x AS (SELECT status, rank() OVER (ORDER BY prs) + (count(*) OVER (PARTITION BY prs) - 1) / 2.0::DOUBLE AS k FROM scores), t AS (SELECT sum(k) FILTER (WHERE status = 1) AS s, count(*) FILTER (WHERE status = 1) AS cases, count(*) FILTER (WHERE status = 0) AS controls FROM x) SELECT round((s - cases * (cases + 1) / 2) / (cases * controls), 6) AS auc, cases, controls FROM t", "scores")
def _auc(r):
    return rounded(statistics.auc(r("scores"), "prs", "status"))


_ETA = "b0 + b1 * x + b2 * s"
_MU = f"(1 / (1 + exp(-({_ETA}))))"
_H = {(i, j): f"sum({_MU} * (1 - {_MU}) * {u} * {v})" for i, u in enumerate(("1", "x", "s")) for j, v in enumerate(("1", "x", "s")) if i <= j}
_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
_INV = [["d * f - e * e", "c * e - b * f", "b * e - c * d"], ["c * e - b * f", "a * f - c * c", "b * c - a * e"], ["b * e - c * d", "b * c - a * e", "a * d - b * b"]]
LOGISTIC = f"""WITH RECURSIVE t AS (SELECT status::DOUBLE AS y, raw / 1000 AS x, sex::DOUBLE AS s FROM scores WHERE raw IS NOT NULL),
  n(k, b0, b1, b2) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL SELECT k + 1, {", ".join(f"b{i} + (({_INV[i][0]}) * g0 + ({_INV[i][1]}) * g1 + ({_INV[i][2]}) * g2) / {_DET}" for i in range(3))} FROM (
    SELECT k, b0, b1, b2, sum(y - {_MU}) AS g0, sum((y - {_MU}) * x) AS g1, sum((y - {_MU}) * s) AS g2, {_H[0, 0]} AS a, {_H[0, 1]} AS b, {_H[0, 2]} AS c, {_H[1, 1]} AS d, {_H[1, 2]} AS e, {_H[2, 2]} AS f FROM n, t WHERE k < 12 GROUP BY k, b0, b1, b2)),
  z AS (SELECT b0, b1, b2, {_H[0, 0]} AS a, {_H[0, 1]} AS b, {_H[0, 2]} AS c, {_H[1, 1]} AS d, {_H[1, 2]} AS e, {_H[2, 2]} AS f, sum(y * ({_ETA}) - ln(1 + exp({_ETA}))) AS ll, count(*) AS m, avg(y) AS p FROM n, t WHERE k = 12 GROUP BY b0, b1, b2),
  r AS (SELECT unnest(['(intercept)', 'x', 'sex']) AS term, unnest([b0, b1, b2]) AS v, unnest([{", ".join(f"sqrt(({_INV[i][i]}) / {_DET})" for i in range(3))}]) AS se, ll, m, m * (p * ln(p) + (1 - p) * ln(1 - p)) AS l0 FROM z)
  SELECT term, round(v, 6) AS estimate, round(se, 6) AS se, round(v / se, 6) AS z, round(exp(v), 6) AS odds_ratio, round(exp(v - 1.96 * se), 6) AS ci_low, round(exp(v + 1.96 * se), 6) AS ci_high, round((1 - exp(2 * (l0 - ll) / m)) / (1 - exp(2 * l0 / m)), 6) AS r2 FROM r"""


@book.add("logistic_estimates", LOGISTIC, "scores")
def _logistic_estimates(r):
    """All of logistic_fit but its p-values: SQL has no normal distribution."""
    s = r("scores").withColumn("x", F.col("raw") / 1000)
    return rounded(statistics.logistic(s, "status", ["x", "sex"]).drop("p"))


@book.add("logistic_fit", None)
def _logistic(r):
    s = r("scores").withColumn("x", F.col("raw") / 1000)
    return rounded(statistics.logistic(s, "status", ["x", "sex"]))


@book.add("jackknife_slope", """WITH b AS (SELECT sample_id % 20 AS g, raw, prs FROM scores), x AS (SELECT k, (SELECT regr_slope(raw, prs) FROM b WHERE g <> k) AS s FROM range(20) t(k))
  SELECT round((SELECT regr_slope(raw, prs) FROM b), 6) AS slope, round(sqrt(19.0 / 20 * 20 * var_pop(s)), 6) AS se, count(*) AS blocks FROM x""", "scores")
def _jackknife(r):
    return rounded(statistics.jackknife_slope(r("scores").withColumn("g", F.col("sample_id") % 20), "raw", "prs", "g"))


@book.add("tertiles_by_sex", "WITH e AS (SELECT quantile_cont(raw, 0.3333333333333333) AS a, quantile_cont(raw, 0.6666666666666666) AS b FROM scores) SELECT sex, (1 + (raw > a)::INT + (raw > b)::INT)::INT AS tertile, count(*) AS n, round(avg(prs), 6) AS mean, round(stddev_samp(prs), 6) AS sd FROM scores, e GROUP BY 1, 2", "scores")
def _tertiles(r):
    return rounded(windows.quantile_groups(r("scores"), "raw", 3, "tertile").groupBy("sex", "tertile").agg(F.count("*").alias("n"), F.avg("prs").alias("mean"), F.stddev_samp("prs").alias("sd")))


@book.add("column_profile", "SELECT * FROM (SELECT 'PATID' AS \"column\", count(*) - count(PATID) AS nulls, round(100.0 * count(PATID) / count(*), 4) AS filled_percent, min(PATID)::VARCHAR AS smallest, max(PATID)::VARCHAR AS largest FROM cohort UNION ALL SELECT 'D040', count(*) - count(D040), round(100.0 * count(D040) / count(*), 4), min(D040)::VARCHAR, max(D040)::VARCHAR FROM cohort UNION ALL SELECT 'ICD10_UNDERLYING', count(*) - count(ICD10_UNDERLYING), round(100.0 * count(ICD10_UNDERLYING) / count(*), 4), min(ICD10_UNDERLYING), max(ICD10_UNDERLYING) FROM cohort)", "cohort")
def _profile(r):
    return statistics.profile(r("cohort").select("PATID", "D040", "ICD10_UNDERLYING"))


@book.add("value_counts_nulls", "SELECT ICD10_UNDERLYING, count(*) AS n FROM cohort GROUP BY 1")
def _counts(r):
    return statistics.value_counts(r("cohort"), "ICD10_UNDERLYING")


@book.add("chain_average", "SELECT PRS_ID, round(avg(BETA), 6) AS mean, round(quantile_cont(BETA, 0.5), 6) AS median, count(DISTINCT l_linenumber) AS chains FROM annotated WHERE cadd >= 5 GROUP BY PRS_ID")
def _chains(r):
    return rounded(statistics.chain_average(r("annotated"), "PRS_ID", "BETA", "l_linenumber", F.col("cadd") >= 5))


@book.add("winsorized", "WITH e AS (SELECT quantile_cont(raw, 0.01) AS a, quantile_cont(raw, 0.99) AS b FROM scores) SELECT sample_id, round(least(greatest(raw, a), b), 6) AS w FROM scores, e", "scores")
def _winsor(r):
    return rounded(windows.winsorize(r("scores"), "raw", 0.01, 0.99, "w").select("sample_id", "w"))


# ---- ranking and roll-ups ---------------------------------------------------


@book.add("ranking_score_sql", f"WITH {RANKED} SELECT PRS_ID, CHROM, POS, l_orderkey, l_linenumber, round(BETA, 6) AS BETA, rank_score FROM ranked", "annotated")
def _rank_sql(r):
    return rounded(ranked(r).select(*ROW, "rank_score"))


@book.add("ranking_score", f"""SELECT PRS_ID, CHROM, POS, l_orderkey, l_linenumber, round(BETA, 6) AS BETA, round(0.25::DOUBLE * {RARE} + 0.3::DOUBLE * CASE WHEN {CSQ} < 0.5 AND regulatory_element_type = 'promoter' THEN greatest({CSQ}, 0.8::DOUBLE) ELSE {CSQ} END + 0.2::DOUBLE * {CADD}
  + 0.1::DOUBLE * least(1.0::DOUBLE, revel_score) + 0.1::DOUBLE * (upper(gene_name) IN (SELECT gene_symbol FROM clinical))::INT::DOUBLE + 0.05::DOUBLE * is_lof::INT::DOUBLE, 4) AS rank_score FROM annotated""", "annotated clinical")
def _rank(r):
    return rounded(ranking.ranking_score(r("annotated"), r("clinical")).select(*ROW, "rank_score"))


@book.add("top150_per_category", f"WITH {RANKED}, t AS (SELECT *, {CATEGORY} AS category FROM ranked), k AS (SELECT category, rank_score, PRS_ID, POS, l_orderkey, row_number() OVER (PARTITION BY category ORDER BY rank_score DESC NULLS LAST, PRS_ID, POS, l_orderkey, l_linenumber, BETA) AS rn FROM t) SELECT category, rank_score, PRS_ID, POS, l_orderkey, rn FROM k WHERE rn <= 150", "annotated")
def _top(r):
    t = ranked(r).withColumn("category", ranking.category(F.col("consequence")))
    return first_per(t, ["category"], [F.col("rank_score").desc_nulls_last(), *map(F.col, ("PRS_ID", "POS", "l_orderkey", "l_linenumber", "BETA"))], 150, "rn").select("category", "rank_score", "PRS_ID", "POS", "l_orderkey", F.col("rn").cast("long").alias("rn"))


@book.add("dedup_best_cadd", "SELECT CHROM, POS, EFFECT_ALLELE, max(cadd) AS cadd FROM annotated GROUP BY 1, 2, 3")
def _dedup(r):
    return first_per(r("annotated"), ["CHROM", "POS", "EFFECT_ALLELE"], [F.col("cadd").desc_nulls_last(), F.col("l_orderkey"), F.col("l_linenumber")]).select("CHROM", "POS", "EFFECT_ALLELE", "cadd")


@book.add("gene_rollup", f"""WITH {RANKED}, c AS (SELECT gene_name, string_agg(consequence || '=' || c, ';' ORDER BY consequence) AS consequences FROM (SELECT gene_name, consequence, count(*) AS c FROM ranked GROUP BY 1, 2) GROUP BY 1)
  SELECT r.gene_name, count(*) AS n, round(sum(abs(BETA)), 5) AS sum_abs_beta, round(avg(af), 10) AS mean_af, round(avg(cadd), 10) AS mean_cadd, round(avg(rank_score), 10) AS mean_score, any_value(c.consequences) AS consequences FROM ranked r JOIN c USING (gene_name) GROUP BY r.gene_name""", "annotated")
def _rollup(r):
    return rounded(ranking.gene_rollup(ranked(r)).withColumn("sum_abs_beta", F.round("sum_abs_beta", 5)), 10)


@book.add("gene_pgs_matrix", f"WITH {RANKED}, t AS (SELECT *, {CATEGORY} AS category FROM ranked) SELECT gene_name, PRS_ID, count(*) AS n, count(*) FILTER (WHERE category IN ('pLoF', 'missense', 'synonymous')) AS n_coding, count(*) FILTER (WHERE contains(consequence, 'splice')) AS n_splice, round(sum(abs(BETA)), 5) AS sum_abs_beta, round(avg(cadd), 9) AS mean_cadd, max(rank_score) AS max_score, round(avg(rank_score), 9) AS mean_score FROM t GROUP BY 1, 2 HAVING count(*) >= 3", "annotated")
def _matrix(r):
    return rounded(ranking.gene_score_matrix(ranked(r), 3).withColumn("sum_abs_beta", F.round("sum_abs_beta", 5)), 9)


@book.add("clinical_panel", f"WITH {RANKED} SELECT upper(gene_name) AS gene, confidence, count(DISTINCT (CHROM, POS, EFFECT_ALLELE)) AS n_variants, round(sum(abs(BETA)), 5) AS genetic_load, round(sum(rank_score), 5) AS cumulative_score, count(DISTINCT PRS_ID) AS n_scores FROM ranked JOIN clinical ON upper(gene_name) = gene_symbol GROUP BY 1, 2", "annotated clinical")
def _panel(r):
    return rounded(ranking.clinical_panel(ranked(r), r("clinical")), 5)


@book.add("gene_info", """WITH g AS (SELECT gene_name, CHROM, count(*) AS c FROM annotated GROUP BY 1, 2), p AS (SELECT gene_name, arg_max(CHROM, {'a': c, 'b': CHROM}) AS chrom FROM g GROUP BY 1)
  SELECT a.gene_name, any_value(p.chrom) AS chrom, min(POS) AS min_pos, max(POS) AS max_pos, count(*) AS n, count(DISTINCT PRS_ID) AS n_scores, """ + ", ".join(f"count(*) FILTER (WHERE rarity_class = '{x}') AS n_{x}" for x in ("common", "low_frequency", "rare", "ultra_rare", "novel")) + " FROM annotated a JOIN p USING (gene_name) GROUP BY a.gene_name", "annotated")
def _info(r):
    return ranking.gene_info(r("annotated"))


@book.add("gene_counts_scalar_vs_exploded", """WITH a AS (SELECT gene_name AS gene, count(*) AS a FROM annotated WHERE gene_name <> '' GROUP BY 1), b AS (SELECT gene, count(*) AS b FROM (SELECT unnest(list_distinct(string_split(all_overlapping_genes, ','))) AS gene FROM annotated) GROUP BY 1)
  SELECT coalesce(a.gene, b.gene) AS gene, greatest(coalesce(a, 0), coalesce(b, 0)) AS n FROM a FULL JOIN b ON a.gene = b.gene""", "annotated")
def _gene_counts(r):
    return ranking.gene_counts(r("annotated"))


@book.add("variant_filters", "SELECT PRS_ID, CHROM, POS, l_orderkey, l_linenumber, round(BETA, 6) AS BETA FROM annotated WHERE CHROM = 'Brand#7' AND consequence IN ('splice_region_variant', 'splice_site_variant') AND (upper(gene_name) LIKE 'ECONOMY%' OR list_contains(string_split(upper(all_overlapping_genes), ','), 'ECONOMY3')) AND (upper(gene_name) = 'ECONOMY3' OR list_contains(string_split(upper(all_overlapping_genes), ','), 'ECONOMY3'))")
def _filters(r):
    return rounded(ranking.filter_variants(r("annotated"), "Brand#7", "splice_region", "economy3").select(*ROW))


@book.add("variant_filters_substring", "SELECT PRS_ID, CHROM, POS, l_orderkey, l_linenumber, round(BETA, 6) AS BETA FROM annotated WHERE CHROM = 'Brand#7' AND consequence IN ('splice_region_variant', 'splice_site_variant') AND (lower(gene_name) = 'economy3' OR contains(lower(all_overlapping_genes), 'economy3'))", "annotated")
def _filters_substring(r):
    return rounded(ranking.filter_variants(r("annotated"), "Brand#7", "splice_region", "economy3", substring=True).select(*ROW))


_GENES = "SELECT gene_name, n_variants, sum_abs_beta, mean_cadd, n_variants * 0.5::DOUBLE AS ranking_score_mean, clinical FROM (SELECT gene_name, count(*) AS n_variants, round(sum(abs(BETA)), 6) AS sum_abs_beta, round(avg(cadd), 6) AS mean_cadd FROM annotated GROUP BY 1) LEFT JOIN (SELECT gene_symbol, confidence AS clinical FROM clinical) c ON gene_symbol = upper(gene_name)"


def _gene_table(r):
    g = rounded(r("annotated").groupBy("gene_name").agg(F.count("*").alias("n_variants"), F.sum(F.abs("BETA")).alias("sum_abs_beta"), F.avg("cadd").alias("mean_cadd")))
    c = r("clinical").select("gene_symbol", F.col("confidence").alias("clinical"))
    return g.join(c, F.upper("gene_name") == F.col("gene_symbol"), "left").drop("gene_symbol").withColumn("ranking_score_mean", F.col("n_variants") * 0.5)


for _sort, _expr in ranking.GENE_SORTS.items():
    _dir = "DESC" if _sort != "alphabetical" else "ASC"
    _key = "gene_name" if _sort == "alphabetical" else f"coalesce({_expr}, 0)"
    book.add(f"gene_browse_{_sort}", f"SELECT gene_name, n_variants, row_number() OVER (ORDER BY {_key} {_dir}, gene_name) AS place FROM ({_GENES}) WHERE contains(upper(gene_name), 'AR') AND n_variants >= 3 AND clinical = 'high'", "annotated clinical")(
        lambda r, by=_sort: ranking.browse_genes(_gene_table(r), q="ar", sort_by=by, min_variants=3, confidence="HIGH", place="place").select("gene_name", "n_variants", F.col("place").cast("long").alias("place"))
    )


@book.add("page_slice", "SELECT sample_id, raw FROM scores ORDER BY raw DESC, sample_id LIMIT 20 OFFSET 40")
def _page(r):
    return ranking.page(r("scores").select("sample_id", "raw"), [F.desc("raw"), F.col("sample_id")], 3, 20)[0]


@book.add("merge_gene_sources", """WITH g AS (SELECT DISTINCT gene_symbol FROM clinical), s AS (SELECT gene_symbol, 'strong' AS evidence, 3 AS power, 'a' AS source FROM g WHERE length(gene_symbol) % 2 = 0 UNION ALL SELECT gene_symbol, 'limited', 1, 'b' FROM g),
  m AS (SELECT gene_symbol, arg_max(evidence, power) AS evidence, max(power) AS power, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS k FROM s GROUP BY 1), cv AS (SELECT gene_symbol FROM g WHERE contains(gene_symbol, 'A') UNION SELECT 'EXTRA')
  SELECT coalesce(m.gene_symbol, cv.gene_symbol) AS gene_symbol, evidence, coalesce(sources, 'clinvar') AS sources, cv.gene_symbol IS NOT NULL AS in_clinvar,
   CASE WHEN coalesce(power, 0) >= 3 OR coalesce(k, 0) >= 2 AND cv.gene_symbol IS NOT NULL THEN 'high' WHEN coalesce(power, 0) >= 2 OR coalesce(k, 0) >= 1 AND cv.gene_symbol IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM m FULL JOIN cv ON m.gene_symbol = cv.gene_symbol""", "clinical")
def _genes(r):
    g = r("clinical").select("gene_symbol").distinct()
    a = g.where(F.length("gene_symbol") % 2 == 0).withColumn("evidence", F.lit("strong"))
    b = g.withColumn("evidence", F.lit("limited"))
    cv = g.where(F.col("gene_symbol").contains("A")).select(F.col("gene_symbol").alias("symbol")).union(g.sparkSession.createDataFrame([("EXTRA",)], "symbol string"))
    return ranking.merge_gene_sources({"a": a, "b": b}, {"strong": 3, "limited": 1}, cv)
