"""Summaries, histograms, agreement, odds ratios, regressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exact_quantiles, running_sum, small, store_round


def summary(df: DataFrame, value: str, by: Sequence[str] = (), percents: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, sd (sample), min, max and exact percentiles p05 ... of a column, by group."""
    names = [f"p{round(q * 100):02d}" for q in percents]
    if by:
        p = [F.expr(f"percentile({value}, {q})").alias(n) for q, n in zip(percents, names, strict=True)]
    else:  # no task holds all values of a whole table
        p = [F.lit(x).cast("double").alias(n) for x, n in zip(exact_quantiles(df, value, percents), names, strict=True)]
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), *p)


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin (from 0), lower edge, n of equal-width bins from min to max; the last bin holds the max, empty bins are there with 0.

    Equal values all fall in bin 0.  No rows: no bins.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    counts = v.select(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(small(counts), "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def stacked_bins(df: DataFrame, value: str, category: str, categories: Sequence[str], bins: int = 25, mean: str | None = None) -> DataFrame:
    """Counts of each category in equal-width bins as columns, empty bins with 0, and the mean of ``mean`` by bin."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    width = (float(hi) - float(lo)) / bins or 1.0
    b = F.least(F.floor((F.col(value) - F.lit(float(lo))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    aggs = [F.count(F.when(F.col(category) == c, 1)).alias(c) for c in categories]
    got = df.where(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(*aggs, F.avg(mean or value).alias("mean"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(small(got), "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in categories], "mean")


def log_spectrum(df: DataFrame, af: str, by: str) -> DataFrame:
    """Counts of frequencies by log10 in steps of a tenth; zero and null have no bin."""
    x = F.floor(F.log10(F.nullif(F.col(af), F.lit(0.0))) * 10 + 0.5) / 10
    return df.where(F.col(af) > 0).groupBy(x.alias("log_af"), by).agg(F.count("*").alias("n"))


def megabase_bins(df: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Rows by chromosome and window: count, first and last position, greatest and summed |BETA|, consequence of the greatest."""
    a = F.abs("BETA")
    best = F.max_by("consequence", F.struct(a, F.col("consequence"), F.col("POS")))
    return df.groupBy("CHROM", F.floor(F.col("POS") / width).alias("bin")).agg(F.count("*").alias("n"), F.min("POS").alias("min_pos"), F.max("POS").alias("max_pos"), F.max(a).alias("max_abs_beta"), F.sum(a).alias("sum_abs_beta"), best.alias("top_consequence"))


def value_counts(df: DataFrame, column: str, nulls: bool = True) -> DataFrame:
    return (df if nulls else df.where(F.col(column).isNotNull())).groupBy(column).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], total: str = "TOTAL") -> DataFrame:
    """Counts of row by column values with a total column and a total row; null rows are `NULL`."""
    r = F.coalesce(F.col(row).cast("string"), F.lit("NULL"))
    cells = [F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values]
    base = df.select(r.alias(row), column)
    out = base.rollup(row).agg(F.grouping(row).alias("g"), *cells, F.count("*").alias(total))
    return out.select(F.when(F.col("g") == 1, total).otherwise(F.col(row)).alias(row), *[str(v) for v in values], total)


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: nulls, percent filled, smallest and largest value as text; one pass over the data."""
    aggs = [F.count("*").alias("_n")]
    for i, c in enumerate(df.columns):
        q = F.col(f"`{c}`")
        aggs += [F.count(q).alias(f"n{i}"), F.min(q).cast("string").alias(f"lo{i}"), F.max(q).cast("string").alias(f"hi{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"n{i}")).alias("nulls"), F.round(F.try_divide(100.0 * F.col(f"n{i}"), F.col("_n")), 4).alias("filled_percent"), F.col(f"lo{i}").alias("smallest"), F.col(f"hi{i}").alias("largest")) for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.inline(rows))


def agreement(df: DataFrame, a: str, b: str, within: Sequence[float] = (1.0, 5.0)) -> DataFrame:
    """Pearson and Spearman correlation, mean and greatest difference, its percentiles, shares within bounds of two columns."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = average_rank(average_rank(both, "a", "ra"), "b", "rb")
    d = F.abs(F.col("a") - F.col("b"))
    shares = [F.avg((d <= w).cast("double")).alias(f"within_{w:g}") for w in within]
    median, p95 = exact_quantiles(both, d, [0.5, 0.95])
    return ranked.agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.avg(d).alias("mae"), F.max(d).alias("max_diff"), F.lit(median).cast("double").alias("median_diff"), F.lit(p95).cast("double").alias("p95_diff"), *shares)


def average_rank(df: DataFrame, value: str, into: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank of each value, equal ones sharing their mean.

    Distinct values are counted first, so the window runs over them and not
    over rows; a value that many rows share is one row of it.
    """
    key, n = "_value", "_n"
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias(key)).agg(F.count("*").alias(n))
    if by:
        counts = counts.withColumn("_to", F.sum(n).over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        counts = running_sum(counts, [F.col(key)], F.col(n), "_to")
    rank = F.col("_to") - F.col(n) + (F.col(n) + 1) / F.lit(2.0)
    ranks = counts.select(*[F.col(c).alias(f"_k_{c}") for c in by], key, rank.cast("double").alias(into))
    on = [df[value] == ranks[key]] + [df[c].eqNullSafe(ranks[f"_k_{c}"]) for c in by]
    return df.join(ranks, on, "left").drop(key, *[f"_k_{c}" for c in by])


def coverage(df: DataFrame, value: str, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Share of values within k standard deviations of the mean, by k."""
    m, s = df.agg(F.avg(value), F.stddev_samp(value)).first()
    d = F.abs(F.col(value) - F.lit(m))
    wide = df.where(F.col(value).isNotNull()).agg(*[F.avg((d <= F.lit(k * (s or 0.0))).cast("double")).alias(str(k)) for k in ks])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("share")) for k in ks])))


def decile_odds(df: DataFrame, decile: str = "decile", case: str = "case", reference: int = 5) -> DataFrame:
    """Cases, percent and odds ratio against the reference group with Woolf's 95 % interval, by group."""
    t = df.where(F.col(case).isNotNull()).groupBy(decile).agg(F.count("*").alias("n"), F.sum(F.col(case).cast("long")).alias("cases"))
    ref = t.where(F.col(decile) == reference).select((F.col("n") - F.col("cases")).alias("ref_controls"), F.col("cases").alias("ref_cases"))
    both = t.join(F.broadcast(ref), how="left")  # one row
    a, b = F.col("cases").cast("double"), (F.col("n") - F.col("cases")).cast("double")
    c, d = F.col("ref_cases").cast("double"), F.col("ref_controls").cast("double")
    log = F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), F.ln(a * d / (b * c)))
    se = F.sqrt(1 / F.nullif(a, F.lit(0.0)) + 1 / F.nullif(b, F.lit(0.0)) + 1 / F.nullif(c, F.lit(0.0)) + 1 / F.nullif(d, F.lit(0.0)))
    return both.select(decile, "n", "cases", (100.0 * a / F.col("n")).alias("percent"), F.exp(log).alias("odds_ratio"), F.exp(log - 1.96 * se).alias("ci_low"), F.exp(log + 1.96 * se).alias("ci_high"))


def prevalence(df: DataFrame, group: str, case: str, predicted: str | None = None) -> DataFrame:
    """Share of cases by group, and the mean prediction beside it."""
    more = [F.avg(predicted).alias("predicted")] if predicted else []
    return df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(case).cast("double")).alias("observed"), *more)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function of numbers from 0 on: its power series up to 2, its continued fraction beyond."""
    out = np.full(x.shape, np.nan)
    low, high = x < 2, x >= 2
    if low.any():
        v = x[low]
        term, total = v.copy(), v.copy()
        for n in range(1, 60):
            term = -term * v * v / n
            total += term / (2 * n + 1)
        out[low] = 1 - 2 / math.sqrt(math.pi) * total
    if high.any():
        v = np.minimum(x[high], 40.0)  # 0 in double precision from there on
        f = np.zeros(len(v))
        for n in range(150, 0, -1):
            f = n / 2 / (v + f)
        out[high] = np.exp(-v * v) / math.sqrt(math.pi) / (v + f)
    return out


def two_sided_p(z: Column | str) -> Column:
    """Two-sided p-value of a normal deviate, in Arrow batches: there is no normal distribution among the SQL functions."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(erfc(np.abs(x.to_numpy(float, na_value=np.nan)) / math.sqrt(2)))

    return p(z)


def meta_analysis(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("CHROM", "POS", "A0", "A1")) -> DataFrame:
    """Inverse-variance weighted effect of variants in both inputs (BETA, SE, N, FREQ)."""
    cols = ("BETA", "SE", "N", "FREQ")
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols])
    j = left.join(right, list(keys)).where("SE_a > 0 and SE_b > 0")
    wa, wb = 1 / F.pow("SE_a", 2), 1 / F.pow("SE_b", 2)
    beta, se = (wa * F.col("BETA_a") + wb * F.col("BETA_b")) / (wa + wb), F.sqrt(1 / (wa + wb))
    n = F.col("N_a") + F.col("N_b")
    freq = (F.col("FREQ_a") * F.col("N_a") + F.col("FREQ_b") * F.col("N_b")) / n
    return j.select(*keys, beta.alias("BETA"), se.alias("SE"), (beta / se).alias("Z"), n.alias("N"), freq.alias("FREQ")).withColumn("P", two_sided_p("Z"))


def auc(df: DataFrame, score: str, case: str) -> DataFrame:
    """Area under the ROC curve by the rank sum of cases, equal scores sharing their rank."""
    r = average_rank(df.where(F.col(score).isNotNull() & F.col(case).isNotNull()), score, "_rank")
    t = r.agg(F.sum(F.when(F.col(case) == 1, F.col("_rank"))).alias("s"), F.sum((F.col(case) == 1).cast("double")).alias("n1"), F.sum((F.col(case) == 0).cast("double")).alias("n0"))
    return t.select(F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")).alias("auc"), F.col("n1").cast("long").alias("cases"), F.col("n0").cast("long").alias("controls"))


def logistic(df: DataFrame, case: str, features: Sequence[str], steps: int = 12) -> DataFrame:
    """Logistic regression: term, estimate, standard error, z, p, odds ratio with 95 % interval, Nagelkerke's R2.

    Newton's method; each step is one aggregation of the gradient and the
    information matrix, whose sizes depend on the number of features only.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = df.select(F.col(case).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).na.drop()
    rows = store_round(rows)  # read once a step
    k = len(x)
    beta = np.zeros(k)

    def sums(beta) -> tuple:
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        w = p * (1 - p)
        cells = [F.sum((F.col("y") - p) * F.col(f"x{i}")) for i in range(k)] + [F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
        ll = F.sum(F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))
        got = rows.agg(*cells, ll, F.count("*"), F.avg("y")).first()
        h = np.zeros((k, k))
        at = k
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = got[at]
                at += 1
        return np.array(got[:k], float), h, got[at], got[at + 1], got[at + 2]

    for _ in range(steps):
        g, h, ll, n, base = sums(beta)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    g, h, ll, n, base = sums(beta)
    null = n * (base * math.log(base) + (1 - base) * math.log(1 - base))
    r2 = (1 - math.exp(2 * (null - ll) / n)) / (1 - math.exp(2 * null / n))
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    out = []
    for name, b, s in zip(["(intercept)", *features], beta.tolist(), se.tolist(), strict=True):
        z = b / s
        out.append((name, b, s, z, math.erfc(abs(z) / math.sqrt(2)), math.exp(b), math.exp(b - 1.96 * s), math.exp(b + 1.96 * s), r2))
    return df.sparkSession.createDataFrame(out, "term string, estimate double, se double, z double, p double, odds_ratio double, ci_low double, ci_high double, r2 double")


def jackknife_slope(df: DataFrame, y: str, x: str, block: str) -> DataFrame:
    """Slope of y on x with a standard error by leaving out one block at a time.

    Sums are kept by block; a block's slope comes from the totals less its own.
    """
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(block).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(x) * F.col(x)).alias("sxx"))
    total = Window.partitionBy()
    names = ("n", "sx", "sy", "sxy", "sxx")
    t = s.select(*[F.col(c) for c in names], *[F.sum(c).over(total).alias(f"t_{c}") for c in names])

    def slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
        return (n * sxy - sx * sy) / (n * sxx - sx * sx)

    t = t.withColumn("all", slope(*[F.col(f"t_{c}") for c in names])).withColumn("out", slope(*[F.col(f"t_{c}") - F.col(c) for c in names]))
    b = F.count("*")
    return t.agg(F.first("all").alias("slope"), F.sqrt((b - 1) / b * (b * F.var_pop("out"))).alias("se"), b.alias("blocks"))


def population_counts(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """Rows and conditional counts by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def chain_average(df: DataFrame, key: str, value: str, chain: str, valid: Column) -> DataFrame:
    """Mean and median over the valid chains of each key."""
    return df.where(valid).groupBy(key).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.count_distinct(chain).alias("chains"))
