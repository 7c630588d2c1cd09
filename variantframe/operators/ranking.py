"""Variant ranking scores and roll-ups by gene and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Component weights, and scores by class.
WEIGHTS = {"rarity": 0.25, "consequence": 0.30, "cadd": 0.20, "revel": 0.10, "clinical": 0.10, "lof": 0.05}
CADD_TOP = 50.0
RARITY = {"ultra-rare": 1.00, "ultra_rare": 1.00, "novel": 0.90, "rare": 0.75, "low_frequency": 0.50, "common": 0.00}
RARITY_OTHER, CONSEQUENCE_OTHER = 0.50, 0.01
CONSEQUENCE = {
    "stop_gained": 1.00,
    "frameshift_variant": 1.00,
    "splice_donor_variant": 0.95,
    "splice_acceptor_variant": 0.95,
    "start_lost": 0.90,
    "stop_lost": 0.85,
    "missense_variant": 0.70,
    "inframe_insertion": 0.65,
    "inframe_deletion": 0.65,
    "splice_site_variant": 0.60,
    "splice_region_variant": 0.55,
    "synonymous_variant": 0.20,
    "coding_sequence_variant": 0.15,
    "5_prime_UTR_variant": 0.10,
    "3_prime_UTR_variant": 0.10,
    "non_coding_exon_variant": 0.08,
    "regulatory_region_variant": 0.07,
    "intron_variant": 0.05,
    "upstream_gene_variant": 0.03,
    "intergenic_variant": 0.01,
}
REGULATORY = {
    "promoter": 0.80,
    "insulator": 0.70,
    "proximal_enhancer": 0.68,
    "distal_enhancer": 0.62,
    "enhancer": 0.65,
    "open_chromatin": 0.40,
    "tfbs": 0.35,
    "regulatory_region": 0.30,
    "silencer": 0.25,
    "repressor": 0.20,
    "regulatory_element": 0.20,
}
#: Consequences by category; all others are non_coding.
CATEGORIES = {
    "pLoF": ("stop_gained", "frameshift_variant", "splice_donor_variant", "splice_acceptor_variant", "start_lost", "stop_lost"),
    "missense": ("missense_variant", "inframe_insertion", "inframe_deletion"),
    "synonymous": ("synonymous_variant", "coding_sequence_variant"),
    "splice_region": ("splice_site_variant", "splice_region_variant"),
}


def lookup_score(table: dict[str, float], key: Column, other: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(other))


def category(consequence: Column) -> Column:
    out = None
    for name, terms in CATEGORIES.items():
        out = F.when(consequence.isin(*terms), name) if out is None else out.when(consequence.isin(*terms), name)
    return out.otherwise("non_coding")


def ranking_score(df: DataFrame, clinical: DataFrame | None = None, regulatory: bool = True, into: str = "rank_score") -> DataFrame:
    """Weighted score from 0 to 1 of annotated variants, rounded to four places.

    Columns that are missing count as unknown: rarity_class_effective (else
    rarity_class), consequence, cadd_phred, revel_score (texts or numbers),
    gene_name, is_lof, regulatory_element_type.  ``clinical`` has gene_symbol.
    The regulatory bonus raises the consequence score where that is below 0.5.
    """
    has = set(df.columns)
    rare = "rarity_class_effective" if "rarity_class_effective" in has else "rarity_class" if "rarity_class" in has else None
    rarity = lookup_score(RARITY, F.lower(F.coalesce(F.col(rare), F.lit("novel"))), RARITY_OTHER) if rare else F.lit(RARITY_OTHER)
    csq = lookup_score(CONSEQUENCE, F.coalesce("consequence", F.lit("intergenic_variant")), CONSEQUENCE_OTHER) if "consequence" in has else F.lit(CONSEQUENCE_OTHER)
    if regulatory and "regulatory_element_type" in has:
        bonus = lookup_score(REGULATORY, F.lower(F.coalesce("regulatory_element_type", F.lit(""))), 0.0)
        csq = F.when(csq < 0.5, F.greatest(csq, bonus)).otherwise(csq)

    def number(name: str, top: float) -> Column:
        if name not in has:
            return F.lit(0.0)
        v = F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(0.0))
        return F.least(F.greatest(F.when(F.isnan(v), 0.0).otherwise(v), F.lit(0.0)), F.lit(top)) / top

    lof = F.coalesce(F.col("is_lof").cast("boolean"), F.lit(False)).cast("double") if "is_lof" in has else F.lit(0.0)
    clin: Column = F.lit(0.0)
    if clinical is not None and "gene_name" in has:
        genes = clinical.select(F.upper("gene_symbol").alias("_gene")).distinct().withColumn("_clinical", F.lit(1.0))
        df = df.join(genes, F.upper("gene_name") == F.col("_gene"), "left").drop("_gene")
        clin = F.coalesce("_clinical", F.lit(0.0))
    w = WEIGHTS
    score = w["rarity"] * rarity + w["consequence"] * csq + w["cadd"] * number("cadd_phred", CADD_TOP) + w["revel"] * number("revel_score", 1.0) + w["clinical"] * clin + w["lof"] * lof
    return df.withColumn(into, F.round(score, 4)).drop("_clinical")


def gene_rollup(df: DataFrame) -> DataFrame:
    """Variants, summed |BETA|, mean AF, CADD and score, and counts by consequence of each gene."""
    counts = df.groupBy("gene_name", "consequence").agg(
        F.count("*").alias("c"), F.sum(F.abs("BETA")).alias("b"), F.sum("af").alias("fa"), F.count("af").alias("na"), F.sum("cadd").alias("fc"), F.count("cadd").alias("nc"), F.sum("rank_score").alias("fs")
    )
    pairs = F.sort_array(F.collect_list(F.struct("consequence", "c")))  # one entry for each consequence term
    out = counts.where("gene_name is not null and gene_name <> ''").groupBy("gene_name").agg(
        F.sum("c").alias("n"), F.sum("b").alias("sum_abs_beta"), F.try_divide(F.sum("fa"), F.sum("na")).alias("mean_af"), F.try_divide(F.sum("fc"), F.sum("nc")).alias("mean_cadd"), F.try_divide(F.sum("fs"), F.sum("c")).alias("mean_score"), pairs.alias("p")
    )
    text = F.array_join(F.transform("p", lambda x: F.concat_ws("=", F.coalesce(x["consequence"], F.lit("?")), x["c"].cast("string"))), ";")
    return out.withColumn("consequences", text).drop("p")


def gene_score_matrix(df: DataFrame, least: int = 1) -> DataFrame:
    """Gene by score: variants, coding and splice counts, summed |BETA|, mean CADD, greatest and mean ranking score."""
    coding, splice = category(F.col("consequence")).isin("pLoF", "missense", "synonymous"), F.col("consequence").contains("splice")
    out = df.groupBy("gene_name", "PRS_ID").agg(
        F.count("*").alias("n"), F.count_if(coding).alias("n_coding"), F.count_if(splice).alias("n_splice"), F.sum(F.abs("BETA")).alias("sum_abs_beta"), F.avg("cadd").alias("mean_cadd"), F.max("rank_score").alias("max_score"), F.avg("rank_score").alias("mean_score")
    )
    return out.where(F.col("n") >= least)


def clinical_panel(df: DataFrame, clinical: DataFrame) -> DataFrame:
    """Clinical genes: distinct variants, genetic load (summed |BETA|), cumulative score, scores they occur in."""
    genes = clinical.select(F.upper("gene_symbol").alias("gene"), "confidence").dropDuplicates(["gene"])
    j = df.withColumn("gene", F.upper("gene_name")).join(genes, "gene")
    v = F.struct("CHROM", "POS", "EFFECT_ALLELE")
    return j.groupBy("gene", "confidence").agg(F.count_distinct(v).alias("n_variants"), F.sum(F.abs("BETA")).alias("genetic_load"), F.sum("rank_score").alias("cumulative_score"), F.count_distinct("PRS_ID").alias("n_scores"))


def gene_info(df: DataFrame) -> DataFrame:
    """Most frequent chromosome, span, counts and rarity counts of each gene."""
    by = df.groupBy("gene_name", "CHROM").agg(F.count("*").alias("c"), F.min("POS").alias("lo"), F.max("POS").alias("hi"))
    place = by.groupBy("gene_name").agg(F.max_by("CHROM", F.struct("c", "CHROM")).alias("chrom"), F.min("lo").alias("min_pos"), F.max("hi").alias("max_pos"), F.sum("c").alias("n"))
    rest = df.groupBy("gene_name").agg(F.count_distinct("PRS_ID").alias("n_scores"), *[F.count_if(F.col("rarity_class") == r).alias(f"n_{r}") for r in ("common", "low_frequency", "rare", "ultra_rare", "novel")])
    return place.join(rest, "gene_name")


def gene_counts(df: DataFrame, scalar: str = "gene_name", listed: str = "all_overlapping_genes") -> DataFrame:
    """Variants of each gene, counted by the scalar column and by the comma list; the greater count holds."""
    one = df.where(F.col(scalar) != "").groupBy(F.col(scalar).alias("gene")).agg(F.count("*").alias("a"))
    many = df.select(F.explode(F.array_distinct(F.transform(F.split(listed, ","), lambda x: F.trim(x)))).alias("gene")).where("gene <> ''").groupBy("gene").agg(F.count("*").alias("b"))
    return one.join(many, "gene", "full").select("gene", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("n"))


def merge_gene_sources(sources: dict[str, DataFrame], strength: dict[str, int], clinvar: DataFrame) -> DataFrame:
    """Genes of all sources (gene_symbol, evidence): best evidence, sources, whether in ClinVar, confidence tier."""
    rows = None
    for name, df in sources.items():
        part = df.select(F.upper(F.trim("gene_symbol")).alias("gene_symbol"), "evidence", F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    power = lookup_score({k: float(v) for k, v in strength.items()}, F.coalesce("evidence", F.lit("")), 0.0)
    best = F.max_by("evidence", F.struct(power, F.col("evidence")))
    merged = rows.where("gene_symbol <> ''").groupBy("gene_symbol").agg(best.alias("evidence"), F.max(power).alias("power"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.count_distinct("source").alias("k"))
    cv = clinvar.select(F.upper("symbol").alias("gene_symbol")).distinct().withColumn("cv", F.lit(True))
    out = merged.join(cv, "gene_symbol", "full")
    in_cv = F.coalesce("cv", F.lit(False))
    power = F.coalesce("power", F.lit(0.0))
    tier = F.when((power >= 3) | (F.coalesce("k", F.lit(0)) >= 2) & in_cv, "high").when((power >= 2) | (F.coalesce("k", F.lit(0)) >= 1) & in_cv, "medium").otherwise("low")
    return out.select("gene_symbol", "evidence", F.coalesce("sources", F.lit("clinvar")).alias("sources"), in_cv.alias("in_clinvar"), tier.alias("confidence"))


def filter_variants(df: DataFrame, chrom: str | None = None, region: str | None = None, gene: str | None = None, coding: bool | None = None, confidence: Sequence[str] | None = None, listed: str = "all_overlapping_genes", substring: bool = False) -> DataFrame:
    """Composed filters: chromosome, region class (splice_region means its two consequences), gene (exact, or in the list; with ``substring`` anywhere in the list's text), coding, confidence."""
    out = df
    if chrom:
        out = out.where(F.col("CHROM") == chrom)
    if region == "splice_region":
        out = out.where(F.col("consequence").isin("splice_region_variant", "splice_site_variant"))
    elif region:
        out = out.where(F.col("region_class") == region)
    if gene:
        g = F.upper("gene_name") == gene.upper()
        if listed in df.columns:
            g = g | (F.contains(F.upper(listed), F.lit(gene.upper())) if substring else F.array_contains(F.split(F.upper(listed), ","), gene.upper()))
        out = out.where(g)
    if coding is not None:
        out = out.where(F.col("is_coding") == coding)
    if confidence:
        out = out.where(F.col("confidence").isin(*confidence))
    return out


#: Sort keys of the gene table and the columns they stand for.
GENE_SORTS = {"ranking_score": "ranking_score_mean", "variant_count": "n_variants", "sum_abs_beta": "sum_abs_beta", "mean_cadd": "mean_cadd", "alphabetical": "gene_name"}


def browse_genes(genes: DataFrame, q: str = "", sort_by: str = "sum_abs_beta", descending: bool = True, min_variants: int = 1, confidence: str | None = None, clinical_only: bool = False, place: str | None = None) -> DataFrame:
    """Genes whose symbol contains ``q`` (case ignored), with at least so many variants, and of a clinical confidence, in order.

    ``genes`` has gene_name, the figures of `GENE_SORTS` and ``clinical``, the
    confidence of a clinical gene or null.  An unknown sort key is
    sum_abs_beta; null figures count as 0; symbols run the other way, so that
    they begin with A where figures begin with the greatest; ties go by symbol.
    ``place`` keeps the position, from 1, under that name: what passes the
    filters is then ordered in one task, which a table of genes bounds.
    """
    out = genes
    if q.strip():
        out = out.where(F.contains(F.upper("gene_name"), F.lit(q.strip().upper())))
    if min_variants > 1:
        out = out.where(F.col("n_variants") >= min_variants)
    if clinical_only:
        out = out.where(F.col("clinical").isNotNull())
    if confidence:
        out = out.where(F.lower("clinical") == confidence.lower())
    if sort_by == "alphabetical":
        order = [F.asc("gene_name") if descending else F.desc("gene_name")]
    else:
        key = F.coalesce(F.col(GENE_SORTS.get(sort_by, "sum_abs_beta")), F.lit(0))
        order = [key.desc() if descending else key.asc(), F.asc("gene_name")]
    if place:
        return out.withColumn(place, F.row_number().over(Window.orderBy(*order)))
    return out.orderBy(*order)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, most: int = 500) -> tuple[DataFrame, dict[str, int]]:
    """Rows of one page under a total order, and totals; page and size are drawn in to what there is."""
    size = max(1, min(size, most))
    total = df.count()
    pages = max(1, -(-total // size))
    number = max(1, min(number, pages))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), {"total": total, "pages": pages, "page": number, "size": size}
