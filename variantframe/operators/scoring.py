"""Polygenic scores: dosage-weighted sums by sample, from long or array dosages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small


def score_samples(matched: DataFrame, dosages: DataFrame, missing: str = "mean") -> DataFrame:
    """PRS = sum of BETA times dosage by sample, and n_variants, from long dosages (zarr_idx, sample_id, dosage).

    Flipped variants count 2 - dosage.  ``missing``: a null dosage becomes the
    variant's mean over samples, ``zero`` or is skipped; variants without any
    dosage add nothing.  Partial sums are made before the shuffle, so samples
    with many variants are no hot keys.
    """
    m = matched.groupBy("zarr_idx", "flip").agg(F.sum("BETA").alias("BETA"))  # weights of one catalog row add up
    d = dosages.join(small(m), "zarr_idx").withColumn("d", F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage")))
    if missing == "mean":
        means = d.groupBy("zarr_idx", "flip").agg(F.avg("d").alias("mean_d"))
        d = d.join(small(means), ["zarr_idx", "flip"]).withColumn("d", F.coalesce("d", "mean_d"))
    elif missing == "zero":
        known = d.groupBy("zarr_idx").agg(F.count("dosage").alias("n")).where("n > 0").select("zarr_idx")
        d = d.join(small(known), "zarr_idx", "left_semi").withColumn("d", F.coalesce("d", F.lit(0.0)))
    elif missing != "skip":
        raise ValueError("missing is mean, zero or skip")
    d = d.where("d is not null")
    return d.groupBy("sample_id").agg(F.sum(F.col("BETA") * F.col("d")).alias("PRS"), F.count("*").alias("n_variants"))


def score_arrays(matched: DataFrame, variants: DataFrame, samples: Sequence[str] | None = None, missing: str = "mean", counts: bool = False) -> DataFrame:
    """The same scores from one row for each variant with an array of dosages (zarr_idx, dosages); sample is the place in the array.

    Only matched variants' arrays are read.  Each partition adds up one vector
    of samples, and the vectors' elements are summed by place: what is shuffled
    grows with partitions times samples, not with variants.  ``counts`` adds
    n_variants; with ``skip`` samples without any dosage are left out.
    """
    m = matched.groupBy("zarr_idx", "flip").agg(F.sum("BETA").alias("BETA"))
    rows = variants.select("zarr_idx", F.col("dosages").cast("array<double>").alias("dosages")).join(small(m), "zarr_idx")

    def add(batches):
        total = n = None
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("dosages"))
            ends = lists.offsets.to_numpy()
            every = lists.values.to_numpy(zero_copy_only=False)  # nulls are NaN
            flips, betas = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("flip", "BETA"))
            for lo, hi, flip, beta in zip(ends[:-1], ends[1:], flips, betas, strict=True):
                d = 2 - every[lo:hi] if flip else every[lo:hi]
                gap = np.isnan(d)
                if len(d) == 0 or gap.all():
                    continue
                if gap.any():  # a skipped dosage adds 0 and doesn't count
                    d = np.where(gap, d[~gap].mean() if missing == "mean" else 0.0, d)
                if total is None:
                    total, n = np.zeros(len(d)), np.zeros(len(d), np.int64)
                total = total + beta * d
                n += ~gap if missing == "skip" else 1
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(n)], ["place", "part", "n"])

    parts = rows.mapInArrow(add, "place bigint, part double, n bigint")
    out = parts.groupBy("place").agg(F.sum("part").alias("PRS"), F.sum("n").alias("n_variants"))
    if missing == "skip":
        out = out.where("n_variants > 0")
    values = ["PRS", "n_variants"] if counts else ["PRS"]
    if samples is None:
        return out.select(F.col("place").alias("sample"), *values)
    names = out.sparkSession.createDataFrame([(i, s) for i, s in enumerate(samples)], "place bigint, sample_id string")
    return out.join(small(names), "place").select("sample_id", *values)


#: Cells that a task of `score_cells` holds before those of equal samples are added up.
CELLS = 1 << 20


def score_cells(matched: DataFrame, variants: DataFrame) -> DataFrame:
    """The scores of `score_samples` with ``skip`` from rows with arrays of known dosages and their samples (zarr_idx, sample_ids, dosages).

    A task adds up what it holds by sample, so it needs no vector of all
    samples; the sums of tasks are added by sample.
    """
    m = matched.groupBy("zarr_idx", "flip").agg(F.sum("BETA").alias("BETA"))
    rows = variants.join(small(m), "zarr_idx").select("flip", "BETA", "sample_ids", F.col("dosages").cast("array<double>").alias("dosages"))
    kind = rows.schema["sample_ids"].dataType.elementType.simpleString()
    most = CELLS

    def add(batches):
        held, size = [], 0

        def summed() -> pa.Table:
            sums = pa.concat_tables(held).group_by("sample_id").aggregate([("part", "sum"), ("n", "sum")])
            return pa.table([sums.column(c) for c in ("sample_id", "part_sum", "n_sum")], names=["sample_id", "part", "n"])

        for batch in batches:
            flips, betas, samples, dosages = (batch.column(i) for i in range(4))
            times = pc.list_value_length(dosages).to_numpy()
            d = dosages.flatten().to_numpy()
            d = np.where(np.repeat(flips.to_numpy(zero_copy_only=False), times), 2 - d, d)
            parts = np.repeat(betas.to_numpy(zero_copy_only=False), times) * d
            held.append(pa.table([samples.flatten(), pa.array(parts), pa.array(np.ones(len(parts), np.int64))], names=["sample_id", "part", "n"]))
            size += len(parts)
            if size > most:
                held = [summed()]
                if (size := len(held[0])) > most // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
        if held:
            yield from summed().combine_chunks().to_batches(max_chunksize=1 << 16)

    sums = rows.mapInArrow(add, f"sample_id {kind}, part double, n bigint")
    return sums.groupBy("sample_id").agg(F.sum("part").alias("PRS"), F.sum("n").alias("n_variants"))


def score_by_chrom(matched: DataFrame, dosages: DataFrame, chroms: Sequence[str]) -> DataFrame:
    """Scores of each chromosome as columns PRS_<chrom>, and their sum PRS_total; chromosomes without variants are 0."""
    m = matched.groupBy("CHROM", "zarr_idx", "flip").agg(F.sum("BETA").alias("BETA"))
    d = dosages.join(small(m), "zarr_idx").where("dosage is not null")
    term = F.col("BETA") * F.when(F.col("flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    wide = d.withColumn("term", term).groupBy("sample_id").pivot("CHROM", list(chroms)).agg(F.sum("term"))
    parts = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in chroms]
    return wide.select("sample_id", *[p.alias(f"PRS_{c}") for p, c in zip(parts, chroms, strict=True)], sum(parts[1:], parts[0]).alias("PRS_total"))


def merge_score_files(files: Sequence[DataFrame], id: str = "sample_id", score: str = "PRS") -> DataFrame:
    """Sum of scores over files; a sample that a file lacks, or a null, counts 0."""
    out = files[0].select(id, score)
    for f in files[1:]:
        out = out.unionByName(f.select(id, score))
    return out.groupBy(id).agg(F.sum(F.coalesce(F.col(score), F.lit(0.0))).alias(score))


def align_samples(main: DataFrame, other: DataFrame, id: str = "sample_id", place: str = "place") -> DataFrame:
    """Each sample of the main order with its place there and in another order; null where the other lacks it."""
    a = main.select(id, F.col(place).alias("main_place"))
    return a.join(other.select(id, F.col(place).alias("other_place")), id, "left")


def dosage_spread(dosages: DataFrame, tiny: float = 1e-9) -> DataFrame:
    """Standard deviation of each variant's dosages and whether it varies at all."""
    out = dosages.groupBy("zarr_idx").agg(F.stddev_samp("dosage").alias("sd"), F.count("dosage").alias("n"))
    return out.withColumn("varies", F.coalesce(F.col("sd") > tiny, F.lit(False)))


def heterozygosity(dosages: DataFrame, male_below: float = 0.1) -> DataFrame:
    """Share of heterozygous calls of each sample and the sex that it tells on chromosome X."""
    out = dosages.where("dosage is not null").groupBy("sample_id").agg(F.avg((F.col("dosage") == 1).cast("double")).alias("het_rate"), F.count("*").alias("n"))
    return out.withColumn("sex", F.when(F.col("het_rate") < male_below, "male").otherwise("female"))
