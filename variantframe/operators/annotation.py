"""Annotation of variants: features, regulatory elements, codons, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantframe.functions.alleles import codon_consequence, complement, indel_consequence, replace_base, translate_codon
from variantframe.functions.scalars import ANNOTATOR_PRIORITY, effective_frequency, rarity

from .common import first_per
from .ranges import best_covering, range_join
from .windows import coding_offsets

#: How specific a feature is, its region class, consequence by region, and impact order.
FEATURE_RANK = {"CDS": 0, "five_prime_UTR": 1, "three_prime_UTR": 2, "exon": 3, "transcript": 4, "gene": 5}
REGION = {"CDS": "coding", "five_prime_UTR": "UTR_5prime", "three_prime_UTR": "UTR_3prime", "exon": "non_coding_exon", "transcript": "intronic", "gene": "intronic"}
CONSEQUENCE = {
    "coding": "coding_sequence_variant",
    "UTR_5prime": "5_prime_UTR_variant",
    "UTR_3prime": "3_prime_UTR_variant",
    "non_coding_exon": "non_coding_exon_variant",
    "intronic": "intron_variant",
    "splice_region": "splice_region_variant",
    "near_gene": "upstream_gene_variant",
    "regulatory": "regulatory_region_variant",
    "intergenic": "intergenic_variant",
}
IMPACT = {
    "stop_gained": 50,
    "frameshift_variant": 60,
    "stop_lost": 70,
    "start_lost": 80,
    "splice_donor_variant": 100,
    "splice_acceptor_variant": 110,
    "splice_site_variant": 120,
    "inframe_insertion": 150,
    "inframe_deletion": 160,
    "splice_region_variant": 200,
    "missense_variant": 250,
    "synonymous_variant": 280,
    "coding_sequence_variant": 300,
    "5_prime_UTR_variant": 400,
    "3_prime_UTR_variant": 500,
    "non_coding_exon_variant": 600,
    "intron_variant": 700,
    "upstream_gene_variant": 800,
    "regulatory_region_variant": 850,
    "intergenic_variant": 900,
}
UPSTREAM, SPLICE_SITE, SPLICE_REGION = 2_000, 2, 8
LOSS = ("stop_gained", "stop_lost", "start_lost", "frameshift_variant")


def _lookup(table: dict, key: Column, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(other))


def best_features(variants: DataFrame, features: DataFrame, every: bool = False) -> DataFrame:
    """Best feature of each variant and comma lists of all genes hit.

    ``variants``: variant_id, CHROM, pos (0-based).  ``features``: CHROM, feature,
    begin, end, strand, gene_name, gene_id, gene_type, transcript_id.  The most
    specific feature wins, protein_coding at ties, then the smaller gene and
    transcript id.  A variant's hits are first reduced to one for each gene.
    With ``every`` there is a row for each row of ``variants``, with nulls where
    no feature is, else one for each variant hit.
    """
    gene, other = F.coalesce("gene_id", "gene_name", F.lit("?")), (F.col("gene_type") != "protein_coding").cast("int")
    texts = {"all_overlapping_genes": F.coalesce("gene_name", F.lit("")), "all_overlapping_transcripts": F.coalesce("transcript_id", F.lit("")), "all_region_classes": _lookup(REGION, F.col("feature"), "intergenic")}
    f = features.withColumns({"rank": _lookup(FEATURE_RANK, F.col("feature"), 999), "other": other, "gene": gene, **texts, "transcript_id": texts["all_overlapping_transcripts"]})
    order = ["rank", "other", "gene", "transcript_id", "feature", "strand", "gene_name", "gene_id", "gene_type"]
    best = ["feature", "strand", "gene_name", "gene_id", "gene_type", "transcript_id"]
    once, again = _by_times(variants)
    how = "left" if every else "inner"
    out = _at_places(once, best_covering(once, f, [F.col(c) for c in order], best, list(texts), "gene"), how).withColumnRenamed("n", "n_overlapping_genes")
    if again is not None:
        per_gene = range_join(again, f).groupBy("variant_id", "gene").agg(F.min(F.struct(*order, *texts)).alias("hit"))
        per_variant = per_gene.groupBy("variant_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
        lists = [F.array_join(F.filter(F.col(f"hits.{c}"), lambda x: x != ""), ",").alias(c) for c in texts]
        merged = per_variant.select("variant_id", *[F.get("hits", 0)[c].alias(c) for c in best], F.size("hits").alias("n_overlapping_genes"), *lists)
        out = out.unionByName(again.select("variant_id").join(merged, "variant_id", "left") if every else merged)
    return out


def _by_times(variants: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Variants whose id comes once, and those whose id comes again, if any: their hits are merged over their rows."""
    v = variants.select("variant_id", "CHROM", "pos")
    if _distinct_ids(v):
        return v, None
    n = v.withColumn("times", F.count("*").over(Window.partitionBy("variant_id")))
    return n.where("times = 1").drop("times"), n.where("times > 1").drop("times")


def _distinct_ids(v: DataFrame) -> bool:
    """Whether no variant_id comes twice.  Whole numbers are counted as bits, 64 neighbours a row, so ids in a row are a small table."""
    i = F.col("variant_id")
    if v.schema["variant_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return v.groupBy(i).agg(F.count("*").alias("times")).where("times > 1").isEmpty()
    i = i.cast("long")
    runs = v.groupBy(F.shiftright(i, 6).alias("run")).agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)).cast("int"))).alias("bits"))
    return runs.where(F.when(F.col("run").isNull(), F.col("n") > 1).otherwise(F.col("n") > F.bit_count("bits"))).isEmpty()


def _at_places(variants: DataFrame, there: DataFrame, how: str = "inner") -> DataFrame:
    """What `best_covering` found at the variants' places, with their variant_id."""
    return variants.join(there, ["CHROM", "pos"], how).drop("CHROM", "pos")


def classify(variants: DataFrame, best: DataFrame, gene_distance: DataFrame | None = None, exon_distance: DataFrame | None = None, regulatory: DataFrame | None = None, codons: DataFrame | None = None, splice: DataFrame | None = None) -> DataFrame:
    """One row for each variant: region_class, consequence, impact order and flags.

    Side tables have variant_id and: gene_distance and exon_distance `distance`;
    regulatory source, element_type, element_id; codons consequence; splice
    splice_type.  Without a feature a regulatory hit comes first, then the
    window before a gene, else intergenic.  Introns near exon ends become splice
    sites or regions.  A codon's consequence holds for coding variants only.
    """
    out = variants.join(best, "variant_id", "left")

    def add(df: DataFrame | None, columns: dict[str, str]) -> None:
        nonlocal out
        if df is None:
            out = out.withColumns({v: F.lit(None).cast("string" if v not in ("gene_d", "exon_d") else "long") for v in columns.values()})
        else:
            out = out.join(df.select("variant_id", *[F.col(a).alias(b) for a, b in columns.items()]), "variant_id", "left")

    add(gene_distance, {"distance": "gene_d"})
    add(exon_distance, {"distance": "exon_d"})
    add(regulatory, {"source": "reg_source", "element_type": "regulatory_element_type", "element_id": "regulatory_element_id"})
    add(codons, {"consequence": "codon_csq"})
    add(splice, {"splice_type": "splice_type"})
    return classified(out)


def classified(out: DataFrame) -> DataFrame:
    """`classify` for variants that have the columns of their best feature and side tables already: gene_d, exon_d, reg_source, regulatory_element_type, regulatory_element_id, codon_csq, splice_type."""
    none, reg = F.col("feature").isNull(), F.col("reg_source").isNotNull()
    near = F.coalesce(F.col("gene_d") <= UPSTREAM, F.lit(False))
    intron = F.col("feature").isin("transcript", "gene")
    site, region = F.coalesce(intron & (F.col("exon_d") <= SPLICE_SITE), F.lit(False)), F.coalesce(intron & (F.col("exon_d") <= SPLICE_REGION), F.lit(False))
    base = F.when(none & reg, "regulatory").when(none & near, "near_gene").when(none, "intergenic").otherwise(_lookup(REGION, F.col("feature"), "intergenic"))
    region_class = F.when(~none & region & ~site, "splice_region").otherwise(base)
    coding = ~none & (base == "coding")
    csq = (
        F.when(site & (F.col("splice_type") == "donor"), "splice_donor_variant")
        .when(site & (F.col("splice_type") == "acceptor"), "splice_acceptor_variant")
        .when(site, "splice_site_variant")
        .when(coding & F.col("codon_csq").isNotNull(), F.col("codon_csq"))
        .otherwise(_lookup(CONSEQUENCE, region_class, "intergenic_variant"))
    )
    out = out.withColumn("region_class", region_class).withColumn("consequence", csq)
    lof = F.col("consequence").isin(*LOSS, "splice_donor_variant", "splice_acceptor_variant")
    return (
        out.withColumn("consequence_priority", _lookup(IMPACT, F.col("consequence"), 900))
        .withColumn("is_coding", coding)
        .withColumn("is_intergenic", none & ~reg)
        .withColumn("is_regulatory", reg | none & near)
        .withColumn("regulatory_source", F.when(reg, F.concat(F.lit("bed:"), "reg_source")).when(none & near, "heuristic"))
        .withColumn("is_lof", lof)
        .withColumn("is_missense", F.col("consequence") == "missense_variant")
        .withColumn("is_synonymous", F.col("consequence") == "synonymous_variant")
        .drop("codon_csq", "reg_source")
        .withColumnRenamed("gene_d", "distance_nearest_gene")
        .withColumnRenamed("exon_d", "distance_to_splice_site")
    )


def regulatory_hits(variants: DataFrame, elements: DataFrame) -> DataFrame:
    """The regulatory element of each variant: highest priority (smallest number), then the smallest start and id."""
    e = elements.select(F.col("chrom").alias("CHROM"), F.col("start").alias("begin"), "end", "name", "source", "element_type", "element_id", "priority")
    order = [F.col("priority").isNull(), F.col("priority"), F.col("begin"), F.col("element_id"), F.col("name")]
    e = e.withColumn("found", F.coalesce(F.nullif("element_id", F.lit("")), "name"))
    v = variants.select("variant_id", "CHROM", "pos")
    once, best = _distinct_ids(v), ["source", "element_type", "found"]
    out = best_covering(v, e, order, best if once else [*best, "priority", "begin", "element_id", "name"], key="variant_id")
    if not once:  # the first of the rows' elements is the first of all
        out = first_per(out, ["variant_id"], order)
    return out.select("variant_id", "source", "element_type", F.col("found").alias("element_id"))


#: Element types by exact name, by transcription factor, and by words in the name, in order.
ELEMENT_NAMES = {"PLS": "promoter", "pELS": "proximal_enhancer", "dELS": "distal_enhancer", "CTCF-only": "insulator", "DNase-H3K4me3": "open_chromatin"}
ELEMENT_FACTORS = {"CTCF": "insulator", "RAD21": "insulator", "SMC3": "insulator", "EP300": "enhancer", "P300": "enhancer", "POLR2A": "promoter", "TBP": "promoter", "TAF1": "promoter", "REST": "repressor", "EZH2": "repressor"}
ELEMENT_WORDS = [("promoter", "promoter"), ("enhancer", "enhancer"), ("insulator", "insulator"), ("silencer", "silencer"), ("repress", "repressor"), ("dnase", "open_chromatin"), ("oreg", "regulatory_region"), ("tfbs", "TFBS")]


def element_type(name: Column, default: str = "regulatory_element") -> Column:
    """Type of a regulatory element by its name: exact, else a known factor, else a word in it."""
    out = F.when(name.isNull() | (F.trim(name) == ""), default)
    for table, key in ((ELEMENT_NAMES, name), (ELEMENT_FACTORS, F.upper(name))):
        for k, v in table.items():
            out = out.when(key == k, v)
    for k, v in ELEMENT_WORDS:
        out = out.when(F.lower(name).contains(k), v)
    return out.otherwise(default)


def chunk_bases(df: DataFrame, sequence: DataFrame, pos: str, into: str, length: int, chrom: str = "CHROM") -> DataFrame:
    """Base at a 0-based position from a table of sequence chunks (chrom, chunk_id, seq) of equal length."""
    s = sequence.select(F.col("chrom").alias("_c"), "chunk_id", "seq")
    j = df.join(s, (F.col(chrom) == F.col("_c")) & (F.floor(F.col(pos) / length) == F.col("chunk_id")), "left")
    return j.withColumn(into, F.upper(F.substring("seq", (F.pmod(F.col(pos), F.lit(length)) + 1).cast("int"), 1))).drop("_c", "chunk_id", "seq")


def codon_consequences(variants: DataFrame, cds: DataFrame, sequence: DataFrame, length: int) -> DataFrame:
    """Consequence of coding variants: variant_id, transcript_id, codon_index, codon_ref, codon_alt, aa_ref, aa_alt, consequence.

    ``variants``: variant_id, CHROM, pos (0-based), REF, ALT.  ``cds``: CHROM,
    transcript_id, begin, end, strand.  A codon's three places are found in the
    transcript's own coordinates, so codons across exons are joined; indels
    follow the rule of their lengths.
    """
    parts = coding_offsets(cds).select("CHROM", "transcript_id", "begin", "end", "strand", "cds_offset")
    hits = range_join(variants.select("variant_id", "CHROM", "pos", "REF", "ALT"), parts)
    plus = F.col("strand") != "-"
    place = F.col("cds_offset") + F.when(plus, F.col("pos") - F.col("begin")).otherwise(F.col("end") - 1 - F.col("pos"))
    hits = hits.withColumn("place", place).withColumn("codon_index", F.floor(F.col("place") / 3)).withColumn("in_codon", F.pmod("place", F.lit(3)))
    snv = (F.length("REF") == 1) & (F.length("ALT") == 1)
    places = hits.where(snv).select("variant_id", "transcript_id", "CHROM", "strand", "ALT", "codon_index", "in_codon", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    places = places.withColumn("at", F.col("codon_index") * 3 + F.col("k"))
    p = parts.select("transcript_id", F.col("begin").alias("b"), F.col("end").alias("e"), F.col("cds_offset").alias("o"))
    inside = (F.col("at") >= F.col("o")) & (F.col("at") < F.col("o") + F.col("e") - F.col("b"))
    spread = places.join(p, "transcript_id").where(inside)  # a transcript's few parts
    spread = spread.withColumn("gpos", F.when(F.col("strand") != "-", F.col("b") + F.col("at") - F.col("o")).otherwise(F.col("e") - 1 - (F.col("at") - F.col("o"))))
    based = chunk_bases(spread, sequence, "gpos", "base", length)
    based = based.withColumn("base", F.when(F.col("strand") == "-", complement(F.col("base"))).otherwise(F.col("base")))
    codon = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "base"))), lambda x: x["base"]), "")
    got = based.groupBy("variant_id", "transcript_id", "strand", "ALT", "codon_index", "in_codon").agg(codon.alias("codon_ref")).where(F.length("codon_ref") == 3)
    alt = F.when(F.col("strand") == "-", complement(F.col("ALT"))).otherwise(F.upper("ALT"))
    got = got.withColumn("codon_alt", replace_base(F.col("codon_ref"), F.col("in_codon").cast("int"), alt))
    out = got.select("variant_id", "transcript_id", "codon_index", "codon_ref", "codon_alt", translate_codon(F.col("codon_ref")).alias("aa_ref"), translate_codon(F.col("codon_alt")).alias("aa_alt"), codon_consequence(F.col("codon_ref"), F.col("codon_alt"), F.col("codon_index")).alias("consequence"))
    none = F.lit(None).cast("string")
    indels = hits.where(~snv).select("variant_id", "transcript_id", "codon_index", none.alias("codon_ref"), none.alias("codon_alt"), none.alias("aa_ref"), none.alias("aa_alt"), indel_consequence(F.col("REF"), F.col("ALT")).alias("consequence"))
    return out.unionByName(indels)


def add_effective_frequency(df: DataFrame, columns: dict[str, str], priority: Sequence[str] = ANNOTATOR_PRIORITY) -> DataFrame:
    """Adds af_effective, af_source and rarity_class_effective from frequency columns by source name."""
    af, source = effective_frequency({k: F.col(v) for k, v in columns.items()}, priority)
    return df.withColumn("af_effective", af).withColumn("af_source", source).withColumn("rarity_class_effective", rarity(F.col("af_effective")))


def annotation_summary(df: DataFrame, by: Sequence[str] = ("CHROM",)) -> DataFrame:
    """Counts by chromosome: all, coding, loss of function, intergenic, regulatory, distinct genes."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("is_coding").alias("n_coding"), F.count_if("is_lof").alias("n_lof"), F.count_if("is_intergenic").alias("n_intergenic"), F.count_if("is_regulatory").alias("n_regulatory"), F.count_distinct("gene_name").alias("n_genes"))


def ideogram(df: DataFrame, most: int = 2000) -> DataFrame:
    """Positions of each chromosome, the first ``most`` in order, with the full count; rows beyond are cut before they are gathered."""
    n = df.groupBy("CHROM").agg(F.count("*").alias("n"))
    some = first_per(df.select("CHROM", "POS", "variant_id"), ["CHROM"], [F.col("POS"), F.col("variant_id")], most)
    return some.groupBy("CHROM").agg(F.sort_array(F.collect_list("POS")).alias("positions")).join(n, "CHROM")
