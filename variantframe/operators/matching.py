"""Matching score weights and summary statistics with a variant catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantframe.functions.alleles import palindromic, strand_partner

from .common import first_per, small


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join; the right side is broadcast if its estimated size allows."""
    return left.join(small(right), list(keys), how)


def align_alleles(catalog: DataFrame, weights: DataFrame) -> DataFrame:
    """Direct (EA is ALT) and swapped (EA is REF) matches in one join on CHROM and POS; adds FLIP."""
    w = weights.select("CHROM", "POS", "EA", "OA", "BETA")
    both = catalog.join(small(w), ["CHROM", "POS"])
    direct = (F.col("ALT") == F.col("EA")) & (F.col("REF") == F.col("OA"))
    swapped = (F.col("ALT") == F.col("OA")) & (F.col("REF") == F.col("EA"))
    return both.where(direct | swapped).select("CHROM", "POS", "REF", "ALT", "BETA", swapped.alias("FLIP"))


def match_candidates(catalog: DataFrame, weights: DataFrame, drop_palindromic: bool = False) -> DataFrame:
    """All acceptable catalog rows of each weight row: by IS_FLIP the expected REF and ALT, or both from the other strand."""
    w = weights.select("rowid", "CHROM", "POS", F.upper("EA").alias("EA"), F.upper("OA").alias("OA"), "IS_FLIP", "BETA")
    if drop_palindromic:
        w = w.where(~palindromic(F.col("EA"), F.col("OA")))
    z = catalog.select("zarr_idx", "CHROM", "POS", F.upper("REF").alias("REF"), F.upper("ALT").alias("ALT"))
    flip = F.col("IS_FLIP") == 1
    ref, alt = F.when(flip, F.col("EA")).otherwise(F.col("OA")), F.when(flip, F.col("OA")).otherwise(F.col("EA"))
    direct = (F.col("REF") == ref) & (F.col("ALT") == alt)
    strand = (F.col("REF") == strand_partner(ref)) & (F.col("ALT") == strand_partner(alt))
    both = z.join(small(w), ["CHROM", "POS"]).where(direct | strand)
    return both.select("rowid", "zarr_idx", "CHROM", "POS", "BETA", flip.alias("flip"), F.when(direct, 0).otherwise(1).alias("is_strand"))


def match_best(catalog: DataFrame, weights: DataFrame, drop_palindromic: bool = False, prefer_direct: bool = True) -> DataFrame:
    """One catalog row for each weight row: direct before strand, then the smallest zarr_idx.

    ``prefer_direct=False`` takes the first acceptable candidate by zarr_idx.
    """
    order = [F.col("is_strand"), F.col("zarr_idx")] if prefer_direct else [F.col("zarr_idx"), F.col("is_strand")]
    return first_per(match_candidates(catalog, weights, drop_palindromic), ["rowid"], order)


def exclusion_reasons(catalog: DataFrame, weights: DataFrame, matched: DataFrame) -> DataFrame:
    """Weight rows without match: position_missing or allele_mismatch."""
    left = weights.join(matched.select("rowid"), "rowid", "left_anti")
    there = catalog.select("CHROM", "POS").distinct().withColumn("there", F.lit(True))
    reason = F.when(F.col("there"), "allele_mismatch").otherwise("position_missing")
    return left.join(there, ["CHROM", "POS"], "left").select("rowid", "CHROM", "POS", reason.alias("reason"))


def position_presence(catalog: DataFrame, weights: DataFrame) -> DataFrame:
    """Every weight row with whether its position is in the catalog."""
    there = catalog.select("CHROM", "POS").distinct().withColumn("there", F.lit(True))
    return weights.join(there, ["CHROM", "POS"], "left").select("rowid", F.coalesce("there", F.lit(False)).alias("in_catalog"))


def match_effect_only(catalog: DataFrame, weights: DataFrame) -> DataFrame:
    """Match on position and effect allele; a missing other allele is inferred, a given one must agree."""
    w = weights.select("rowid", "CHROM", "POS", "EA", "OA", "BETA")
    both = catalog.join(small(w), ["CHROM", "POS"])
    as_alt = F.col("EA") == F.col("ALT")
    as_ref = F.col("EA") == F.col("REF")
    partner = F.when(as_alt, F.col("REF")).when(as_ref, F.col("ALT"))
    kind = F.when(~(as_alt | as_ref), "mismatch").when(F.col("OA").isNull() | (F.col("OA") == partner), F.when(as_alt, "direct").otherwise("flipped")).otherwise("mismatch")
    found = both.select("rowid", "zarr_idx", "BETA", kind.alias("kind"), F.coalesce("OA", partner).alias("other_allele"))
    best = F.when(F.col("kind") == "direct", 0).when(F.col("kind") == "flipped", 1).otherwise(2)
    return first_per(found, ["rowid"], [best, F.col("zarr_idx")])


def weights_on_catalog(catalog: DataFrame, weights: DataFrame) -> DataFrame:
    """Every catalog row with its weight, 0 where there is none; of several weights of a position the first row counts."""
    w = first_per(weights, ["CHROM", "POS"], [F.col("rowid")]).select("CHROM", "POS", "BETA")
    return catalog.join(small(w), ["CHROM", "POS"], "left").select("zarr_idx", "CHROM", "POS", F.coalesce("BETA", F.lit(0.0)).alias("BETA"))


def match_either_id(gwas: DataFrame, panel_ids: DataFrame) -> DataFrame:
    """Rows whose CHROM:POS:A:B or CHROM:POS:B:A is a panel id; the forward one wins; adds panel_id and swapped."""
    fwd = F.concat_ws(":", "CHROM", F.col("POS").cast("string"), "A0", "A1")
    rev = F.concat_ws(":", "CHROM", F.col("POS").cast("string"), "A1", "A0")
    ids = panel_ids.select("id").distinct()
    df = gwas.withColumn("id_fwd", fwd).withColumn("id_rev", rev)
    df = df.join(ids.select(F.col("id").alias("f")), F.col("id_fwd") == F.col("f"), "left")
    df = df.join(ids.select(F.col("id").alias("r")), F.col("id_rev") == F.col("r"), "left")
    return df.where("f is not null or r is not null").withColumn("panel_id", F.coalesce("f", "r")).withColumn("swapped", F.col("f").isNull()).drop("f", "r", "id_fwd", "id_rev")


def liftover_rejoin(gwas: DataFrame, lifted: DataFrame, key: str = "rowid") -> DataFrame:
    """Rows with their new coordinates by surrogate row id; a status tells mapped, chrom_changed and unmapped rows."""
    new = lifted.select(key, F.col("CHROM").alias("new_chrom"), F.col("POS").alias("new_pos"))
    status = F.when(F.col("new_pos").isNull(), "unmapped").when(F.col("new_chrom") != F.col("CHROM"), "chrom_changed").otherwise("mapped")
    return gwas.join(new, key, "left").withColumn("status", status)


def two_source(variants: DataFrame, first: DataFrame, second: DataFrame, value: str = "af") -> DataFrame:
    """Value of each variant from the first source, else the second, in given or swapped allele order; adds value and source."""
    keys = ["CHROM", "POS", "REF", "ALT"]

    def both_ways(src: DataFrame, name: str) -> DataFrame:
        a = src.select(*keys, F.struct(F.lit(0).alias("o"), F.col(value).alias("v")).alias("m"))
        b = src.select("CHROM", "POS", F.col("ALT").alias("REF"), F.col("REF").alias("ALT"), F.struct(F.lit(1).alias("o"), F.col(value).alias("v")).alias("m"))
        return a.unionByName(b).groupBy(*keys).agg(F.min("m").alias(name))

    out = variants.join(both_ways(first, "m1"), keys, "left").join(both_ways(second, "m2"), keys, "left")
    source = F.when(F.col("m1").isNotNull(), "first").when(F.col("m2").isNotNull(), "second")
    return out.select(*variants.columns, F.coalesce("m1", "m2")["v"].alias(value), source.alias("source"))


def match_multiallelic(variants: DataFrame, sites: DataFrame) -> DataFrame:
    """Best match with sites that list ALT alleles by comma: the only ALT, then one of several, then swapped alleles; adds alt_index and kind."""
    alts = sites.select("CHROM", "POS", F.col("REF").alias("sref"), "rsid", F.posexplode(F.split("ALT", ",")).alias("alt_index", "salt"), F.size(F.split("ALT", ",")).alias("n_alt"))
    both = variants.join(alts, ["CHROM", "POS"])
    straight = (F.col("REF") == F.col("sref")) & (F.col("ALT") == F.col("salt"))
    swapped = (F.col("REF") == F.col("salt")) & (F.col("ALT") == F.col("sref"))
    kind = F.when(straight & (F.col("n_alt") == 1), "exact").when(straight, "multi_allelic").otherwise("swapped")
    rank = F.when(straight & (F.col("n_alt") == 1), 0).when(straight, 1).otherwise(2)
    found = both.where(straight | swapped).select(*variants.columns, "rsid", "alt_index", kind.alias("kind"), rank.alias("_r"))
    return first_per(found, variants.columns, [F.col("_r"), F.col("rsid"), F.col("alt_index")]).drop("_r")


def harmonize(stats: DataFrame, panel: DataFrame, min_share: float | None = None) -> DataFrame:
    """Summary statistics on a panel's alleles, effect sign turned where they are swapped; raises if too few rows match."""
    p = panel.select("CHROM", "POS", F.col("A0").alias("p0"), F.col("A1").alias("p1"))
    same = (F.col("A0") == F.col("p0")) & (F.col("A1") == F.col("p1"))
    turned = (F.col("A0") == F.col("p1")) & (F.col("A1") == F.col("p0"))
    out = stats.join(p, ["CHROM", "POS"]).where(same | turned)
    out = out.withColumn("BETA", F.when(same, F.col("BETA")).otherwise(-F.col("BETA"))).withColumn("A0", F.col("p0")).withColumn("A1", F.col("p1")).drop("p0", "p1")
    if min_share is not None and out.count() < min_share * stats.count():
        raise ValueError("too few variants match the panel")
    return out


def variant_lookup(variants: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str] = ("CHROM", "POS", "REF", "ALT")) -> DataFrame:
    """Each variant with a struct of every source's columns, null where the source lacks it; of repeated source rows the smallest counts."""
    out = variants
    for name, df in sources.items():
        rest = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias(name))
        out = out.join(one, list(keys), "left")
    return out
