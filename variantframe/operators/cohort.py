"""Cohort construction: denominators, phenotypes, gates, exports, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantframe.functions.scalars import any_flag, cascade, icd10_site
from variantframe.schemas import COHORT

from .common import exact_quantiles, first_per

#: Baseline flags and their sites, weakest first; a later one overrides.
SITES = [
    ("BASE_OTHCANCER", "OTHER"),
    ("BASE_ORALCANCER", "ORAL"),
    ("BASE_STOMCANCER", "GI"),
    ("BASE_CERVCANCER", "CERVICAL"),
    ("BASE_PROSTATECANCER", "PROSTATE"),
    ("BASE_LUNGCANCER", "LUNG"),
    ("BASE_BREASTCANCER", "BREAST"),
]


def one_per_subject(df: DataFrame, subject: str, flag: Column, tie: str) -> DataFrame:
    """One row of each subject: unflagged rows first, then the smallest tie-breaker."""
    return first_per(df, [subject], [flag.cast("int").asc_nulls_first(), F.col(tie)])


def denominator(a: DataFrame, b: DataFrame, id: str = "PATID", names: tuple[str, str] = ("HAS_EXOME", "HAS_WGS")) -> DataFrame:
    """All subjects of two tables with 0/1 columns for the tables that have them."""
    l, r = a.withColumn(names[0], F.lit(1)), b.withColumn(names[1], F.lit(1))
    return l.join(r, id, "full").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def join_keeping_rows(left: DataFrame, right: DataFrame, id: str) -> DataFrame:
    """Inner join that raises unless every left row has exactly one partner."""
    out = left.join(right, id)
    bad = right.groupBy(id).count().where("count > 1").join(left.select(id), id, "left_semi").take(1) or left.join(right, id, "left_anti").take(1)
    if bad:
        raise ValueError(f"the join on {id} changes the number of rows")
    return out


def phenotype(df: DataFrame, flags: Sequence[str], mortality: str) -> DataFrame:
    """EVIDENCE_BASELINE, EVIDENCE_MORTALITY, CANCER_SOURCE and PHENOTYPE_CANCER_STATUS."""
    out = df.withColumn("EVIDENCE_BASELINE", any_flag([F.col(f) for f in flags])).withColumn("EVIDENCE_MORTALITY", F.coalesce(F.col(mortality).cast("int"), F.lit(0)))
    b, m = F.col("EVIDENCE_BASELINE") == 1, F.col("EVIDENCE_MORTALITY") == 1
    source = F.when(b & ~m, "BASELINE_ONLY").when(~b & m, "MORTALITY_ONLY").when(b & m, "BOTH").otherwise("NONE")
    return out.withColumn("CANCER_SOURCE", source).withColumn("PHENOTYPE_CANCER_STATUS", F.when(b | m, "CASE").otherwise("CONTROL"))


def cancer_site(df: DataFrame, icd: str = "ICD10_UNDERLYING", sites: Sequence[tuple[str, str]] = SITES) -> DataFrame:
    """CANCER_SITE: from baseline flags, else from the cause of death of cases known by it; NONE for controls."""
    case = F.col("PHENOTYPE_CANCER_STATUS") == "CASE"
    by_flag = cascade([(F.col(f) == 1, s) for f, s in sites], "NONE")
    site = F.when(~case, "NONE").when(by_flag != "NONE", by_flag).when(F.col("EVIDENCE_MORTALITY") == 1, icd10_site(F.col(icd))).otherwise("NONE")
    return df.withColumn("CANCER_SITE", site)


def qc_flag(df: DataFrame, column: str, token: str = "6") -> DataFrame:
    """GENOMIC_QC_FLAG: 1 if the flag text contains the token."""
    return df.withColumn("GENOMIC_QC_FLAG", F.coalesce(F.col(column).contains(token), F.lit(False)).cast("int"))


def validation_gate(df: DataFrame, checks: dict[str, Column], unique: str | None = None, rows: int | None = None) -> DataFrame:
    """Violations by check: rows where a condition is not true, surplus rows of a key, difference from an expected count; one pass and one for the key."""
    got = df.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    rows_ = [F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks]
    if rows is not None:
        rows_.append(F.struct(F.lit("row_count").alias("check"), F.abs(F.col("_n") - rows).alias("violations")))
    out = got.select(F.inline(F.array(*rows_))) if rows_ else df.sparkSession.createDataFrame([], "check string, violations bigint")
    if unique:
        extra = df.groupBy(unique).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("violations"))
        out = out.unionByName(extra.select(F.lit(f"unique_{unique}").alias("check"), "violations"))
    return out


def require(gate: DataFrame) -> None:
    """Raise if a gate has violations."""
    bad = gate.where("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def export(df: DataFrame, columns: Sequence[str] = tuple(COHORT)) -> DataFrame:
    """The columns in their fixed order; a missing one raises."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def group_split(df: DataFrame, group: str, percent: int = 80, seed: int = 42, into: str = "split") -> DataFrame:
    """train or validation by group, by the first 32 bits of the MD5 of seed and group, the same in every run and engine; a null group counts as an empty text."""
    bucket = F.pmod(F.conv(F.substring(_digest(group, seed), 1, 8), 16, 10).cast("long"), F.lit(100))
    return df.withColumn(into, F.when(bucket < percent, "train").otherwise("validation"))


def impute_median(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Nulls filled with the median of the training rows."""
    m = {c: exact_quantiles(df.where(train), c, [0.5])[0] for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c])) for c in columns})


def priority_sample(df: DataFrame, keep: Column, key: str, cap: int, seed: int = 42) -> DataFrame:
    """All rows to keep, and others by the order of the MD5 of seed and key up to ``cap`` rows in all (at least the kept ones)."""
    kept = df.where(keep)
    rest = max(0, cap - kept.count())
    others = df.where(~F.coalesce(keep, F.lit(False))).orderBy(_digest(key, seed), key).limit(rest)
    return kept.unionByName(others)


def mapped_sex(samples: DataFrame, iid_to_subject: DataFrame, subject_sex: DataFrame) -> DataFrame:
    """Sex of each sample through its subject; null where a link is missing."""
    return samples.join(iid_to_subject, "IID", "left").join(subject_sex, "PATID", "left")
