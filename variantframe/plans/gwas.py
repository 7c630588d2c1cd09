"""Queries on GWAS tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.functions.alleles import variant_type
from variantframe.functions.scalars import effective_n
from variantframe.operators import gwas, statistics

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add("ivw_meta", """SELECT f.CHROM, f.POS, f.A0, f.A1, round((f.BETA / f.SE ** 2 + m.BETA / m.SE ** 2) / (1 / f.SE ** 2 + 1 / m.SE ** 2), 9) AS BETA, round(sqrt(1 / (1 / f.SE ** 2 + 1 / m.SE ** 2)), 9) AS SE,
  round((f.BETA / f.SE ** 2 + m.BETA / m.SE ** 2) / (1 / f.SE ** 2 + 1 / m.SE ** 2) / sqrt(1 / (1 / f.SE ** 2 + 1 / m.SE ** 2)), 9) AS Z, f.N + m.N AS N, round((f.FREQ * f.N + m.FREQ * m.N) / (f.N + m.N), 9) AS FREQ
  FROM gwas_f f JOIN gwas_m m ON f.CHROM = m.CHROM AND f.POS = m.POS AND f.A0 = m.A0 AND f.A1 = m.A1 WHERE f.SE > 0 AND m.SE > 0""")
def _meta(r):
    return rounded(statistics.meta_analysis(r("gwas_f"), r("gwas_m")).drop("P"), 9)


@book.add("gwas_qc", "SELECT POS, round(BETA, 6) AS BETA FROM gwas_f WHERE least(FREQ, 1 - FREQ) >= 0.01 AND SE > 0")
def _qc(r):
    g = r("gwas_f").withColumn("A1FREQ", F.col("FREQ")).withColumn("INFO", F.lit(0.9))
    return rounded(gwas.qc(g).select("POS", "BETA"))


@book.add("sumstat_qc", "SELECT POS FROM (SELECT *, CASE WHEN POS % 3 = 0 THEN NULL ELSE BETA END AS B, POS % 30 AS C FROM gwas_m) WHERE B IS NOT NULL AND SE > 0 AND FREQ > 0.001 AND FREQ < 0.999 AND C BETWEEN 1 AND 22")
def _sumstat(r):
    g = r("gwas_m").withColumn("BETA", F.when(F.col("POS") % 3 != 0, F.col("BETA"))).withColumn("CHROM", (F.col("POS") % 30).cast("string")).withColumn("P", F.lit(0.5))
    return gwas.sumstat_qc(g, ["BETA", "SE"]).select("POS")


@book.add("sd_consistency", "SELECT POS, round(2 / sqrt(N * SE ** 2 + BETA ** 2), 6) AS sd_ss FROM gwas_m WHERE 2 / sqrt(N * SE ** 2 + BETA ** 2) > 0.5 * FREQ * 5 AND 2 / sqrt(N * SE ** 2 + BETA ** 2) < FREQ * 5 + 0.1 AND 2 / sqrt(N * SE ** 2 + BETA ** 2) > 0.1 AND FREQ * 5 > 0.05")
def _sd(r):
    return rounded(gwas.sd_consistent(r("gwas_m").withColumn("sd", F.col("FREQ") * 5).withColumn("n_eff", F.col("N"))).select("POS", "sd_ss"))


@book.add("effective_sample_size", "SELECT POS, round(4.0 * N * (N + 50) / (N + N + 50), 6) AS n_eff FROM gwas_m")
def _neff(r):
    return rounded(r("gwas_m").select("POS", effective_n(F.col("N"), F.col("N") + 50).alias("n_eff")))


@book.add("variant_types", "SELECT CASE WHEN zarr_idx % 3 = 0 THEN 'SNV' WHEN zarr_idx % 3 = 1 THEN 'INDEL' ELSE 'MNV' END AS kind, count(*) AS n FROM catalog GROUP BY 1")
def _types(r):
    k = F.col("zarr_idx") % 3
    c = r("catalog").withColumn("R", F.when(k == 2, F.concat("REF", "ALT")).otherwise(F.col("REF"))).withColumn("A", F.when(k == 0, F.col("ALT")).otherwise(F.concat("ALT", F.lit("G"))))
    return c.groupBy(variant_type(F.col("R"), F.col("A")).alias("kind")).agg(F.count("*").alias("n"))


@book.add("top_snp_per_gene", "SELECT gene, dataset, SNP, GENPOS, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY gene, dataset ORDER BY P, SNP, GENPOS, l_orderkey) AS rn FROM hits) WHERE rn = 1", "hits")
def _top(r):
    return gwas.top_per_gene(r("hits"), ["gene", "dataset"], "P", ["SNP", "GENPOS", "l_orderkey"]).select("gene", "dataset", "SNP", "GENPOS", "l_orderkey")


@book.add("smallest_per_set", "SELECT dataset, SNP, GENPOS FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY P, GENPOS) AS rn FROM (SELECT DISTINCT dataset, SNP, GENPOS, P FROM hits)) WHERE rn <= 25", "hits")
def _smallest(r):
    h = r("hits").select("dataset", "SNP", "GENPOS", "P").distinct()
    return gwas.top_overall(h, "dataset", "P", "GENPOS", 25).select("dataset", "SNP", "GENPOS")


@book.add("minus_log10_p", "SELECT SNP, GENPOS, l_orderkey, round(-log10(P), 6) AS mlog FROM hits WHERE P > 0")
def _mlog(r):
    return rounded(r("hits").where("P > 0").select("SNP", "GENPOS", "l_orderkey", gwas.minus_log10(F.col("P")).alias("mlog")))


@book.add("compare_effects", "SELECT f.POS AS SNP, f.A1, round(f.BETA, 6) AS beta_a, round(m.BETA, 6) AS beta_b, sign(f.BETA) = sign(m.BETA) AS same_sign, f.BETA = 0 AS zero_a, m.BETA = 0 AS zero_b FROM gwas_f f JOIN gwas_m m ON f.POS = m.POS AND f.A1 = m.A1")
def _compare(r):
    return rounded(gwas.compare_effects(r("gwas_f").withColumn("SNP", F.col("POS")), r("gwas_m").withColumn("SNP", F.col("POS"))))


@book.add("site_qc", """WITH g AS (SELECT zarr_idx AS POS, dosage AS d, CASE WHEN dosage IS NOT NULL AND zarr_idx % 100 + sample_id % 3 * 10 >= 20 THEN dosage END AS x FROM dosage_gaps),
  s AS (SELECT POS, count(*) AS n, count(x) AS called, count(*) FILTER (WHERE x = 0) AS a, count(*) FILTER (WHERE x = 1) AS b, count(*) FILTER (WHERE x = 2) AS c FROM g GROUP BY POS),
  t AS (SELECT *, 1 - called / n::DOUBLE AS f_missing, (2 * c + b) / (2.0::DOUBLE * nullif(called, 0)) AS p FROM s)
  SELECT POS, n, called, round(f_missing, 6) AS f_missing, round(p, 6) AS af FROM t WHERE f_missing <= 0.4 AND p > 0 AND p < 1""", "dosage_gaps")
def _site(r):
    g = r("dosage_gaps").withColumn("GQ", F.col("zarr_idx") % 100 + F.col("sample_id") % 3 * 10)
    g = g.select(F.lit("X").alias("CHROM"), F.col("zarr_idx").alias("POS"), F.lit("A").alias("REF"), F.lit("C").alias("ALT"), "sample_id", "dosage", "GQ", F.lit(30).alias("DP"))
    return rounded(gwas.site_qc(g, missing=0.4).select("POS", "n", "called", "f_missing", "af"))


@book.add("reject_reasons", "SELECT CASE WHEN rowid % 7 = 0 THEN 'chrom' WHEN POS > 50000000 THEN 'pos' WHEN EA NOT IN ('A', 'C', 'G', 'T') THEN 'allele' WHEN BETA < -0.3 THEN 'beta' END AS reject_reason, count(*) AS n FROM weights GROUP BY 1")
def _rejects(r):
    w = r("weights")
    checks = [("chrom", F.col("rowid") % 7 == 0), ("pos", F.col("POS") > 50_000_000), ("allele", ~F.col("EA").isin("A", "C", "G", "T")), ("beta", F.col("BETA") < -0.3)]
    return gwas.reject_reasons(w, checks).groupBy("reject_reason").agg(F.count("*").alias("n"))


@book.add("clump_greedy", """WITH RECURSIVE h AS (SELECT SNP, row_number() OVER (ORDER BY P, SNP) AS k FROM (SELECT SNP, min(P) AS P FROM hits GROUP BY SNP)),
  g(k, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT h.k, CASE WHEN list_contains(chosen, SNP + 1) AND SNP % 10 >= 3 OR list_contains(chosen, SNP - 1) AND (SNP - 1) % 10 >= 3 THEN chosen ELSE list_append(chosen, SNP) END FROM g JOIN h ON h.k = g.k + 1)
  SELECT unnest(chosen) AS SNP FROM g WHERE k = (SELECT max(k) FROM h)""", "hits")
def _clump(r):
    hits = r("hits").groupBy("SNP").agg(F.min("P").alias("P"))
    pairs = hits.select(F.col("SNP").alias("a"), (F.col("SNP") + 1).alias("b"), (F.pmod(F.col("SNP"), F.lit(10)) / 10.0).cast("double").alias("r2"))
    return gwas.clump(hits, pairs, 0.3)
