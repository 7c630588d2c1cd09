"""Ranks, percentiles, deciles, running sums and offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantframe.functions.alleles import chrom_order

from .common import exact_quantiles, running_sum
from .statistics import average_rank


def percentile_rank(df: DataFrame, value: str, into: str = "percentile", by: Sequence[str] = ()) -> DataFrame:
    """100 * average rank / number of values, by group; nulls stay null."""
    ranked = average_rank(df, value, "_rank", by)
    n = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.count(value).alias("_count"))
    if by:
        ranked = ranked.join(n, [ranked[c].eqNullSafe(n[f"_g_{c}"]) for c in by]).drop(*[f"_g_{c}" for c in by])
    else:
        ranked = ranked.join(F.broadcast(n))  # one row
    return ranked.withColumn(into, 100 * F.col("_rank") / F.col("_count")).drop("_rank", "_count")


def integer_percentile(df: DataFrame, value: str, into: str = "percentile") -> DataFrame:
    """Percentile rank between 1 and 100, rounded half to even."""
    return percentile_rank(df, value, into).withColumn(into, F.bround(F.least(F.greatest(F.col(into), F.lit(1.0)), F.lit(100.0)), 0).cast("int"))


def zscore(df: DataFrame, value: str, into: str = "z", by: Sequence[str] = ()) -> DataFrame:
    """Distance from the group's mean in sample standard deviations; 0 where the group does not vary.

    The few group figures are aggregated and joined back, so a group may be of any size.
    """
    figures = df.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    out = df.join(figures, [df[c].eqNullSafe(figures[f"_g_{c}"]) for c in by]) if by else df.join(F.broadcast(figures))
    z = F.when(F.col("_sd") > 0, (F.col(value) - F.col("_mean")) / F.col("_sd")).when(F.col(value).isNotNull(), 0.0)
    return out.withColumn(into, z).drop("_mean", "_sd", *[f"_g_{c}" for c in by])


def ntile(df: DataFrame, value: str, key: str, n: int = 10, into: str = "decile", by: Sequence[str] = ()) -> DataFrame:
    """Groups of equal size in the order of value (nulls first) and key, the larger groups first; without ``by`` over the whole table."""
    if not by:
        total = df.count()
        order = [F.col(value).asc_nulls_first(), F.col(key)]
        row = running_sum(df, order, F.lit(1), "_row")
        size, more = divmod(total, n)
        edge = more * (size + 1)  # rows in the larger groups
        late = more + F.floor((F.col("_row") - 1 - edge) / max(size, 1)) + 1
        group = F.when(F.col("_row") <= edge, F.floor((F.col("_row") - 1) / (size + 1)) + 1).otherwise(late)
        return row.withColumn(into, group.cast("int")).drop("_row")
    return df.withColumn(into, F.ntile(n).over(Window.partitionBy(*by).orderBy(value, key)))


def quantile_groups(df: DataFrame, value: str, n: int = 10, into: str = "decile") -> DataFrame:
    """Groups between exact quantiles, upper edge included, equal values together; nulls have none."""
    edges = exact_quantiles(df, value, [i / n for i in range(1, n)])
    if not edges or edges[0] is None:
        return df.withColumn(into, F.lit(None).cast("int"))
    group = F.lit(1)
    for e in sorted(set(edges)):
        group = group + (F.col(value) > F.lit(e)).cast("int") * edges.count(e)
    return df.withColumn(into, group.cast("int"))


def cumulative_share(df: DataFrame, value: str, key: str, ranks: Sequence[int] | None = None) -> DataFrame:
    """rank and the share of the sum of |value| that the largest ranks hold, at all or at given ranks."""
    a = F.abs(F.col(value))
    rows = df.select(a.alias("a"), key).where("a is not null")
    total = rows.agg(F.sum("a")).first()[0]
    both = running_sum(rows, [F.col("a").desc(), F.col(key)], F.lit(1), "rank")
    both = running_sum(both, [F.col("rank")], F.col("a"), "run")
    out = both.select(F.col("rank").cast("int").alias("rank"), F.try_divide(F.col("run"), F.lit(total)).alias("share"))
    return out if ranks is None else out.where(F.col("rank").isin(*ranks))


def genome_offsets(df: DataFrame, chrom_key: str, pos: str, gap: int = 5_000_000) -> DataFrame:
    """Offset and centre of each chromosome on one axis: the maxima of the chromosomes before it, with gaps."""
    m = df.groupBy(chrom_key).agg(F.max(pos).alias("top"), F.min(pos).alias("low"))
    before = F.coalesce(F.sum(F.col("top") + gap).over(Window.orderBy(chrom_key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("offset", before).select(chrom_key, "offset", (F.col("offset") + (F.col("low") + F.col("top")) / 2).alias("center"))


def genome_coordinates(df: DataFrame, chrom_key: str, pos: str, gap: int = 5_000_000) -> DataFrame:
    offsets = genome_offsets(df, chrom_key, pos, gap).select(chrom_key, "offset")
    return df.join(offsets, chrom_key).withColumn("genome_pos", F.col(pos) + F.col("offset")).drop("offset")


def exclusive_running_sum(df: DataFrame, by: Sequence[str], order: Sequence, value: str, into: str) -> DataFrame:
    """Sum of the values before each row in its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0)))


def coding_offsets(cds: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Bases of the coding sequence before each CDS part of a transcript, in the direction of its strand; parts of one begin in the order of ``ties``."""
    key = F.when(F.col("strand") == "-", -F.col("begin")).otherwise(F.col("begin"))
    return exclusive_running_sum(cds.withColumn("_len", F.col("end") - F.col("begin")), ["transcript_id"], [key, *ties], "_len", "cds_offset").drop("_len")


def winsorize(df: DataFrame, value: str, low: float, high: float, into: str) -> DataFrame:
    """Values drawn in to the given quantiles."""
    a, b = exact_quantiles(df, value, [low, high])
    return df.withColumn(into, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.lit(a)), F.lit(b))))


def genomic_order(df: DataFrame, chromosome: str = "CHROM", pos: str = "POS", ties: Sequence[str] = (), into: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of chromosomes (1 to 22, X, Y, MT, then others by name) and positions; ``ties`` must end in a unique key."""
    order = [chrom_order(F.col(chromosome)), F.col(chromosome), F.col(pos), *[F.col(t) for t in ties]]
    return running_sum(df, order, F.lit(1), into)
