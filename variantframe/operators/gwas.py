"""GWAS tables: quality control, coordinates, top hits, comparisons, clumping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantframe.functions.alleles import palindromic, variant_type

from .common import first_per, store_round


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def qc(df: DataFrame, info: float = 0.8, maf: float = 0.01) -> DataFrame:
    """INFO and minor allele frequency at least the bounds, SE positive, effect finite."""
    minor = F.least(F.col("A1FREQ"), 1 - F.col("A1FREQ"))
    return df.where((F.col("INFO") >= info) & (minor >= maf) & (F.col("SE") > 0) & finite(F.col("BETA")) & finite(F.col("SE")))


def significant_snvs(df: DataFrame, p: float = 5e-8, drop_palindromic: bool = False) -> DataFrame:
    out = df.where((F.col("P") < p) & (variant_type(F.col("ALLELE0"), F.col("ALLELE1")) == "SNV"))
    return out.where(~palindromic(F.col("ALLELE0"), F.col("ALLELE1"))) if drop_palindromic else out


def sumstat_qc(df: DataFrame, required: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Complete rows on autosomes with se > 0, p > 0 and a frequency strictly between the bounds."""
    out = df.na.drop(subset=list(required))
    return out.where((F.col("SE") > 0) & (F.col("P") > 0) & (F.col("FREQ") > low) & (F.col("FREQ") < high) & F.col("CHROM").try_cast("int").between(1, 22))


def sd_consistent(df: DataFrame, sd_val: str = "sd", n: str = "n_eff") -> DataFrame:
    """Keeps variants whose standard deviation told by the effect agrees with the observed one."""
    ss = 2 / F.sqrt(F.col(n) * F.pow("SE", 2) + F.pow("BETA", 2))
    v = F.col(sd_val)
    return df.withColumn("sd_ss", ss).where((ss > 0.5 * v) & (ss < v + 0.1) & (ss > 0.1) & (v > 0.05))


def calibrated_n(sd: Column, se: Column, beta: Column, least: float = 1000.0) -> Column:
    """Effective sample size that the effect's standard error tells, at least the bound."""
    return F.greatest(F.try_divide(F.lit(4.0), F.pow(sd, 2) * F.pow(se, 2)) - F.try_divide(F.pow(beta, 2), F.pow(se, 2)), F.lit(least))


def site_qc(genotypes: DataFrame, gq: int = 20, dp: int = 10, missing: float = 0.05, hwe: float = 1e-10, haploid: Sequence[str] = ("X", "Y", "MT")) -> DataFrame:
    """Sites that pass: calls of low quality count as missing; share missing, Hardy-Weinberg (autosomes), polymorphic, two alleles.

    ``genotypes``: CHROM, POS, REF, ALT, sample_id, dosage (0, 1, 2 or null), GQ, DP.
    """
    ok = F.col("dosage").isNotNull() & (F.col("GQ") >= gq) & (F.col("DP") >= dp)
    d = F.when(ok, F.col("dosage"))
    s = genotypes.groupBy("CHROM", "POS", "REF", "ALT").agg(F.count("*").alias("n"), F.count(d).alias("called"), *[F.count_if(d == i).cast("double").alias(f"g{i}") for i in (0, 1, 2)])
    n = F.col("called").cast("double")
    p = (2 * F.col("g2") + F.col("g1")) / F.nullif(2 * n, F.lit(0.0))
    e = [n * F.pow(1 - p, 2), 2 * n * p * (1 - p), n * F.pow(p, 2)]
    chi = sum((F.pow(F.col(f"g{i}") - x, 2) / F.nullif(x, F.lit(0.0)) for i, x in enumerate(e)), F.lit(0.0))
    # Greatest chi-square (one degree of freedom) whose tail is at least the bound.
    from statistics import NormalDist

    bound = NormalDist().inv_cdf(1 - hwe / 2) ** 2
    s = s.withColumn("f_missing", 1 - n / F.col("n")).withColumn("af", p).withColumn("chi2", chi)
    s = s.where((F.col("f_missing") <= missing) & (F.col("af") > 0) & (F.col("af") < 1) & ~F.col("ALT").contains(","))
    return s.where(F.col("CHROM").isin(*haploid) | (F.coalesce("chi2", F.lit(0.0)) <= bound)).select("CHROM", "POS", "REF", "ALT", "n", "called", "f_missing", "af", "chi2")


def reject_reasons(df: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds reject_reason: the first reason that holds, null for rows to keep."""
    out = None
    for name, bad in reasons:
        out = F.when(F.coalesce(bad, F.lit(True)), name) if out is None else out.when(F.coalesce(bad, F.lit(True)), name)
    return df.withColumn("reject_reason", out)


def top_per_gene(df: DataFrame, keys: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """The row with the smallest p-value of each key."""
    return first_per(df, keys, [F.col(p).asc_nulls_last(), *[F.col(t) for t in tie]])


def top_overall(df: DataFrame, set_key: str, p: str, tie: str, n: int) -> DataFrame:
    """The n smallest p-values of each set, together, each row once."""
    return first_per(df, [set_key], [F.col(p).asc_nulls_last(), F.col(tie)], n)


def compare_effects(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("SNP", "A1")) -> DataFrame:
    """Effects of two fits side by side, whether their signs agree and which are zero."""
    j = a.select(*keys, F.col("BETA").alias("beta_a")).join(b.select(*keys, F.col("BETA").alias("beta_b")), list(keys))
    return j.withColumn("same_sign", F.signum("beta_a") == F.signum("beta_b")).withColumn("zero_a", F.col("beta_a") == 0).withColumn("zero_b", F.col("beta_b") == 0)


def minus_log10(c: Column) -> Column:
    return F.when(c > 0, -F.log10(c))


def clump(hits: DataFrame, r2: DataFrame, least: float = 0.1, id: str = "SNP", p: str = "P") -> DataFrame:
    """Greedy clumping: ids of index variants, given squared correlations (a, b, r2) of pairs.

    A variant becomes an index when it has the smallest p-value among its
    undecided partners; its partners are then dropped.  Every round decides all
    local minima at once, which gives the same result as taking variants one
    by one in the order of their p-values.
    """
    links = r2.where(F.col("r2") >= least).select("a", "b").where("a <> b")
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    key = F.struct(F.col(p).alias("p"), F.col(id).alias("i"))
    open_ = store_round(hits.where(F.col(p).isNotNull()).select(F.col(id).alias("i"), key.alias("k")))
    chosen = None
    while open_.take(1):
        near = links.join(open_.select(F.col("i").alias("b"), F.col("k").alias("kb")), "b").groupBy("a").agg(F.min("kb").alias("best"))
        new = open_.join(near, open_["i"] == near["a"], "left").where("best is null or k < best").select("i")
        new = store_round(new)
        chosen = new if chosen is None else chosen.unionByName(new)
        gone = links.join(new, links["a"] == new["i"], "left_semi").select(F.col("b").alias("i")).unionByName(new)
        open_ = store_round(open_.join(gone, "i", "left_anti"))
    out = chosen if chosen is not None else open_.select("i")
    return out.select(F.col("i").alias(id))
