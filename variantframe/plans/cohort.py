"""Queries on cohorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.functions.scalars import t2d_status
from variantframe.operators import cohort, sets
from variantframe.operators import statistics as st

from .common import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
FLAGS = [f for f, _ in cohort.SITES]
BASE = "least(coalesce(greatest(" + ", ".join(FLAGS) + "), 0), 1)"
PHENO = f"""ph AS (SELECT *, {BASE} AS EVIDENCE_BASELINE, coalesce(D040, 0) AS EVIDENCE_MORTALITY FROM cohort),
pc AS (SELECT *, CASE WHEN EVIDENCE_BASELINE = 1 AND EVIDENCE_MORTALITY = 0 THEN 'BASELINE_ONLY' WHEN EVIDENCE_BASELINE = 0 AND EVIDENCE_MORTALITY = 1 THEN 'MORTALITY_ONLY' WHEN EVIDENCE_BASELINE = 1 THEN 'BOTH' ELSE 'NONE' END AS CANCER_SOURCE,
  CASE WHEN EVIDENCE_BASELINE = 1 OR EVIDENCE_MORTALITY = 1 THEN 'CASE' ELSE 'CONTROL' END AS STATUS FROM ph)"""
ICD = """CASE WHEN ICD10_UNDERLYING IS NULL OR trim(ICD10_UNDERLYING) = '' THEN 'UNKNOWN' WHEN length(ICD10_UNDERLYING) < 3 OR upper(ICD10_UNDERLYING)[1] <> 'C' OR TRY_CAST(substr(ICD10_UNDERLYING, 2, 2) AS INT) IS NULL THEN 'OTHER'
  WHEN substr(ICD10_UNDERLYING, 2, 2) IN ('33', '34') THEN 'LUNG' WHEN substr(ICD10_UNDERLYING, 2, 2) = '50' THEN 'BREAST' WHEN substr(ICD10_UNDERLYING, 2, 2) = '61' THEN 'PROSTATE' WHEN substr(ICD10_UNDERLYING, 2, 2) = '53' THEN 'CERVICAL'
  WHEN TRY_CAST(substr(ICD10_UNDERLYING, 2, 2) AS INT) BETWEEN 15 AND 26 THEN 'GI' WHEN TRY_CAST(substr(ICD10_UNDERLYING, 2, 2) AS INT) BETWEEN 81 AND 96 THEN 'HEMATOLOGIC' WHEN substr(ICD10_UNDERLYING, 2, 2) IN ('76', '80', '97') THEN 'UNKNOWN' ELSE 'OTHER' END"""
SITE = f"""CASE WHEN STATUS = 'CONTROL' THEN 'NONE' WHEN BASE_BREASTCANCER = 1 THEN 'BREAST' WHEN BASE_LUNGCANCER = 1 THEN 'LUNG' WHEN BASE_PROSTATECANCER = 1 THEN 'PROSTATE' WHEN BASE_CERVCANCER = 1 THEN 'CERVICAL'
  WHEN BASE_STOMCANCER = 1 THEN 'GI' WHEN BASE_ORALCANCER = 1 THEN 'ORAL' WHEN BASE_OTHCANCER = 1 THEN 'OTHER' WHEN EVIDENCE_MORTALITY = 1 THEN {ICD} ELSE 'NONE' END"""


def built(r):
    return cohort.cancer_site(cohort.phenotype(r("cohort"), FLAGS, "D040"))


@book.add("cohort_phenotype", f"WITH {PHENO} SELECT PATID, EVIDENCE_BASELINE, EVIDENCE_MORTALITY, CANCER_SOURCE, STATUS AS PHENOTYPE_CANCER_STATUS FROM pc", "cohort")
def _phenotype(r):
    return cohort.phenotype(r("cohort"), FLAGS, "D040").select("PATID", "EVIDENCE_BASELINE", "EVIDENCE_MORTALITY", "CANCER_SOURCE", "PHENOTYPE_CANCER_STATUS")


@book.add("cohort_site_icd", f"WITH {PHENO} SELECT PATID, {SITE} AS CANCER_SITE FROM pc", "cohort")
def _site(r):
    return built(r).select("PATID", "CANCER_SITE")


@book.add("crosstab_margins", f"WITH {PHENO} SELECT coalesce({SITE}, 'TOTAL') AS CANCER_SITE, count(*) FILTER (WHERE STATUS = 'CASE') AS \"CASE\", count(*) FILTER (WHERE STATUS = 'CONTROL') AS CONTROL, count(*) AS TOTAL FROM pc GROUP BY ROLLUP ({SITE})", "cohort")
def _crosstab(r):
    return st.crosstab(built(r), "CANCER_SITE", "PHENOTYPE_CANCER_STATUS", ["CASE", "CONTROL"])


@book.add("grouped_counts_unstacked", f"WITH {PHENO} SELECT MALE, count(*) FILTER (WHERE STATUS = 'CASE') AS \"CASE\", count(*) FILTER (WHERE STATUS = 'CONTROL') AS CONTROL FROM pc GROUP BY MALE", "cohort")
def _unstacked(r):
    return cohort.phenotype(r("cohort"), FLAGS, "D040").groupBy("MALE").pivot("PHENOTYPE_CANCER_STATUS", ["CASE", "CONTROL"]).count().na.fill(0)


@book.add("qc_flag", "SELECT PATID, coalesce(contains(EXOME_MCPS_FLAG, '6'), false)::INT AS GENOMIC_QC_FLAG FROM cohort")
def _qc(r):
    return cohort.qc_flag(r("cohort"), "EXOME_MCPS_FLAG").select("PATID", "GENOMIC_QC_FLAG")


@book.add("prefix_counts", "SELECT count(*) FILTER (WHERE starts_with(ICD10_UNDERLYING, 'C3')) AS c3, count(*) FILTER (WHERE starts_with(ICD10_UNDERLYING, 'C5')) AS c5, count(*) FILTER (WHERE starts_with(ICD10_UNDERLYING, 'D')) AS d FROM cohort")
def _prefix(r):
    i = F.col("ICD10_UNDERLYING")
    return r("cohort").agg(F.count_if(i.startswith("C3")).alias("c3"), F.count_if(i.startswith("C5")).alias("c5"), F.count_if(i.startswith("D")).alias("d"))


@book.add("denominator_full_outer", "SELECT coalesce(a.k, b.k) AS PATID, (a.k IS NOT NULL)::INT AS HAS_EXOME, (b.k IS NOT NULL)::INT AS HAS_WGS FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 7 = 1) b ON a.k = b.k")
def _denominator(r):
    o = r("orders")
    a = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("PATID")).distinct()
    b = o.where("o_orderkey % 7 = 1").select(F.col("o_custkey").alias("PATID")).distinct()
    return cohort.denominator(a, b)


@book.add("set_overlap_counts", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 7 = 1) SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE b.k IS NULL) AS only_first, count(*) FILTER (WHERE a.k IS NULL) AS only_second, count(*) AS either FROM a FULL JOIN b ON a.k = b.k")
def _sets(r):
    o = r("orders")
    return sets.overlap(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 7 = 1"), "o_custkey")


@book.add("set_intersection", "SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 1")
def _intersection(r):
    o = r("orders")
    return sets.shared(o.where("o_orderkey % 3 = 0").select("o_custkey"), o.where("o_orderkey % 7 = 1").select("o_custkey"))


@book.add("set_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def _difference(r):
    return sets.only_in(r("customer").select("c_custkey"), r("orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@book.add("semi_join_restrict", "SELECT zarr_idx, CHROM, POS FROM catalog WHERE POS IN (SELECT POS FROM gwas_m)")
def _restrict(r):
    return sets.restrict(r("catalog").select("zarr_idx", "CHROM", "POS"), r("gwas_m"), ["CHROM", "POS"])


@book.add("union_by_name", "SELECT p_partkey AS k, p_name AS a, NULL AS b FROM part UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def _union(r):
    return sets.union_all(r("part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")), r("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b")))


@book.add("distinct_keys", "SELECT DISTINCT CHROM, POS % 100 AS p FROM catalog")
def _distinct(r):
    return r("catalog").select("CHROM", (F.col("POS") % 100).alias("p")).distinct()


@book.add("one_per_subject", "SELECT k, PATID, flagged FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flagged, PATID) AS rn FROM (SELECT PATID, PATID % 100 AS k, coalesce(contains(EXOME_MCPS_FLAG, '6'), false)::INT AS flagged FROM cohort)) WHERE rn = 1", "cohort")
def _one(r):
    c = cohort.qc_flag(r("cohort"), "EXOME_MCPS_FLAG").select("PATID", (F.col("PATID") % 100).alias("k"), F.col("GENOMIC_QC_FLAG").alias("flagged"))
    return cohort.one_per_subject(c, "k", F.col("flagged"), "PATID").select("k", "PATID", "flagged")


@book.add("validation_gate", f"""WITH {PHENO} SELECT 'sex' AS "check", count(*) FILTER (WHERE NOT MALE IN (0, 1)) AS violations FROM pc UNION ALL SELECT 'case_has_site', count(*) FILTER (WHERE (STATUS = 'CASE') <> ({SITE} <> 'NONE')) FROM pc UNION ALL SELECT 'old', count(*) FILTER (WHERE NOT AGE < 80) FROM pc
  UNION ALL SELECT 'row_count', abs(count(*) - 1000) FROM pc UNION ALL SELECT 'unique_PATID', count(*) - count(DISTINCT PATID) FROM pc""", "cohort")
def _gate(r):
    checks = {"sex": F.col("MALE").isin(0, 1), "case_has_site": (F.col("PHENOTYPE_CANCER_STATUS") == "CASE") == (F.col("CANCER_SITE") != "NONE"), "old": F.col("AGE") < 80}
    return cohort.validation_gate(built(r), checks, "PATID", 1000)


@book.add("cardinality_join", "SELECT PATID, n_nationkey FROM cohort JOIN (SELECT c_custkey AS PATID, c_nationkey AS n_nationkey FROM customer) c USING (PATID)", "cohort")
def _cardinality(r):
    return cohort.join_keeping_rows(r("cohort").select("PATID"), r("customer").select(F.col("c_custkey").alias("PATID"), F.col("c_nationkey").alias("n_nationkey")), "PATID")


@book.add("cohort_export", f"WITH {PHENO} SELECT PATID, 'E' || PATID AS IID_EXOME, 'W' || PATID AS IID_WGS, 1 AS HAS_EXOME, 0 AS HAS_WGS, coalesce(contains(EXOME_MCPS_FLAG, '6'), false)::INT AS GENOMIC_QC_FLAG, AGE, MALE, EVIDENCE_BASELINE, EVIDENCE_MORTALITY, CANCER_SOURCE, {SITE} AS CANCER_SITE, STATUS AS PHENOTYPE_CANCER_STATUS FROM pc", "cohort")
def _export(r):
    c = cohort.qc_flag(built(r), "EXOME_MCPS_FLAG").withColumns({"IID_EXOME": F.concat(F.lit("E"), "PATID"), "IID_WGS": F.concat(F.lit("W"), "PATID"), "HAS_EXOME": F.lit(1), "HAS_WGS": F.lit(0)})
    return cohort.export(c)


@book.add("t2d_three_valued", "SELECT PATID, CASE WHEN D040 = 1 OR AGE / 10.0 >= 6.5 OR BASE_OTHCANCER = 1 THEN 1 WHEN NOT (D040 = 1 OR AGE / 10.0 >= 6.5 OR BASE_OTHCANCER = 1) THEN 0 END AS t2d FROM cohort")
def _t2d(r):
    return r("cohort").select("PATID", t2d_status(F.col("D040"), F.col("AGE") / 10, [F.col("BASE_OTHCANCER")]).alias("t2d"))


@book.add("impute_train_median", "WITH m AS (SELECT quantile_cont(D040, 0.5) AS a, quantile_cont(AGE, 0.5) AS b FROM cohort WHERE PATID % 5 < 4) SELECT PATID, coalesce(D040, a)::DOUBLE AS D040, coalesce(CASE WHEN PATID % 9 <> 0 THEN AGE END, b)::DOUBLE AS AGE FROM cohort, m", "cohort")
def _impute(r):
    c = r("cohort").select("PATID", F.col("D040").cast("double").alias("D040"), F.when(F.col("PATID") % 9 != 0, F.col("AGE")).cast("double").alias("AGE"), F.col("AGE").cast("double").alias("full_age"))
    m = cohort.impute_median(c, ["D040"], F.col("PATID") % 5 < 4).drop("AGE")
    a = cohort.impute_median(c.select("PATID", F.col("full_age").alias("AGE")).withColumn("AGE", F.col("AGE")), ["AGE"], F.col("PATID") % 5 < 4)
    med = c.where(F.col("PATID") % 5 < 4).agg(F.percentile("full_age", F.lit(0.5))).first()[0]
    return m.join(a, "PATID").select("PATID", "D040", F.when(F.col("PATID") % 9 != 0, F.col("AGE")).otherwise(F.lit(med)).alias("AGE"))


@book.add("group_split", "SELECT split, count(*) AS n, count(DISTINCT family) AS families FROM (SELECT family, CASE WHEN ('0x' || substr(md5('42:' || family), 1, 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'validation' END AS split FROM (SELECT PATID % 200 AS family FROM cohort)) GROUP BY split", "cohort")
def _split(r):
    return cohort.group_split(r("cohort").select("PATID", (F.col("PATID") % 200).alias("family")), "family").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("family").alias("families"))


@book.add("priority_sample", "SELECT PATID, AGE FROM cohort WHERE AGE > 85 UNION ALL SELECT PATID, AGE FROM (SELECT PATID, AGE, row_number() OVER (ORDER BY md5('42:' || PATID), PATID) AS k FROM cohort WHERE NOT AGE > 85) WHERE k <= 300 - (SELECT count(*) FROM cohort WHERE AGE > 85)", "cohort")
def _sample(r):
    return cohort.priority_sample(r("cohort").select("PATID", "AGE"), F.col("AGE") > 85, "PATID", 300)


@book.add("chained_mapping", "SELECT o_orderkey AS IID, o_custkey AS PATID, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 2)::INT END AS sex FROM orders")
def _chained(r):
    o = r("orders").select(F.col("o_orderkey").alias("IID"), F.col("o_custkey").alias("PATID"))
    sex = r("customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("PATID"), (F.col("c_custkey") % 2).cast("int").alias("sex"))
    return cohort.mapped_sex(o.select("IID"), o, sex)


@book.add("pairs_per_row", "SELECT p_partkey, x AS a_item, y AS b_item FROM part, unnest(string_split(p_name, ' ')) t(x), unnest(string_split(p_type, 'N')) u(y)")
def _pairs(r):
    p = r("part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", "N").alias("b"))
    return sets.pairs_per_row(p, "a", "b").select("p_partkey", "a_item", "b_item")
