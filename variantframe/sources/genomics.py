"""Genomic text formats as tables: VCF, GFF, GTF, BED, FASTA, frequency files, dosages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantframe.functions.alleles import chrom, genotype_dosage
from variantframe.functions.scalars import info_map

#: Fixed value: feature types that are kept.
FEATURES = ("gene", "transcript", "exon", "CDS", "five_prime_UTR", "three_prime_UTR")


def read_vcf(spark: SparkSession, path: str, samples: Sequence[str] = ()) -> DataFrame:
    """CHROM, POS, ID, REF, ALT, alt_index, FILTER and INFO as a map, one row for each ALT allele; sample columns as maps by FORMAT key.  A POS that is no number is null."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    f = F.split("value", "\t")
    base = lines.select(chrom(F.get(f, 0)).alias("CHROM"), F.get(f, 1).try_cast("long").alias("POS"), F.nullif(F.get(f, 2), F.lit(".")).alias("ID"), F.get(f, 3).alias("REF"), F.split(F.get(f, 4), ",").alias("alts"), F.get(f, 6).alias("FILTER"), info_map(F.get(f, 7)).alias("INFO"), *[sample_map(F.get(f, 8), F.get(f, 9 + i)).alias(s) for i, s in enumerate(samples)])
    return base.select("CHROM", "POS", "ID", "REF", F.posexplode("alts").alias("alt_index", "ALT"), "FILTER", "INFO", *samples)


def sample_map(form: Column, sample: Column) -> Column:
    """Map of a VCF sample field by its FORMAT keys; values that are cut off at the end are null."""
    keys, values = F.split(form, ":"), F.split(sample, ":")
    return F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.get(values, i)))


def allele_counts(sample: Column, alt_index: Column) -> tuple[Column, Column]:
    """AN and the AC of one ALT allele from a sample map."""
    an = F.try_element_at(sample, F.lit("AN")).try_cast("long")
    ac = F.get(F.split(F.try_element_at(sample, F.lit("AC")), ","), alt_index).try_cast("long")
    return an, ac


def info_value(info: Column, key: str, alt_index: Column | None = None) -> Column:
    """An INFO value, or the ALT allele's entry of a list; dots are null."""
    v = F.try_element_at(info, F.lit(key))
    v = F.get(F.split(v, ","), alt_index) if alt_index is not None else v
    return F.nullif(v, F.lit("."))


def clinvar_table(vcf: DataFrame) -> DataFrame:
    i = F.col("INFO")
    return vcf.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), *[info_value(i, k.upper()).alias(k) for k in ("clnsig", "clndn", "clnrevstat", "alleleid", "clnvc")], F.concat(F.lit("rs"), info_value(i, "RS")).alias("rsid"))


def frequency_table(vcf: DataFrame, fields: Sequence[str] = ("AF", "AF_afr", "AF_amr", "AF_eas", "AF_nfe", "AF_sas", "AF_mid")) -> DataFrame:
    i, k = F.col("INFO"), F.col("alt_index")
    return vcf.select("CHROM", "POS", "REF", "ALT", *[info_value(i, f, k).try_cast("double").alias(f.lower()) for f in fields], info_value(i, "AN").try_cast("long").alias("an"), info_value(i, "nhomalt", k).try_cast("long").alias("nhomalt"))


def split_cpra(df: DataFrame, column: str = "CPRA") -> DataFrame:
    """chrom, pos, ref, alt of a `chrom:pos:ref:alt` key; keys with other than four parts are dropped."""
    p = F.split(column, ":")
    pos = F.get(p, 1).try_cast("long")
    out = df.where((F.size(p) == 4) & pos.isNotNull())
    return out.select(chrom(F.get(p, 0)).alias("chrom"), pos.alias("pos"), F.get(p, 2).alias("ref"), F.get(p, 3).alias("alt"), *[c for c in df.columns if c != column])


def read_gff(spark: SparkSession, path: str, features: Sequence[str] = FEATURES, equals: str = "=") -> DataFrame:
    """Features in 0-based half-open coordinates, attributes as columns; GTF attributes with ``equals=" "``."""
    raw = spark.read.option("sep", "\t").option("comment", "#").option("quote", "\u0000").schema("c string, s string, feature string, b bigint, e bigint, score string, strand string, phase string, a string").csv(path)
    raw = raw.where(F.col("feature").isin(*features))

    def attr(*names: str) -> Column:
        found = [F.nullif(F.regexp_extract("a", rf'(?:^|;)\s*{n}\s*{"=" if equals == "=" else " "}\s*"?([^";]*)', 1), F.lit("")) for n in names]
        return F.coalesce(*found)

    return raw.select(chrom(F.col("c")).alias("CHROM"), "feature", (F.col("b") - 1).alias("begin"), F.col("e").alias("end"), "strand", attr("gene_name", "Name").alias("gene_name"), attr("gene_id").alias("gene_id"), attr("gene_type", "gene_biotype").alias("gene_type"), attr("transcript_id").alias("transcript_id"), attr("transcript_type", "transcript_biotype").alias("transcript_type"))


def read_bed(spark: SparkSession, path: str, names: Sequence[str] = ("name",), bin_column: bool = False, canonical: bool = True) -> DataFrame:
    """Intervals of a BED file (or a genome browser table with a bin column first), headers skipped."""
    f = F.split("value", "\t")
    k = 1 if bin_column else 0
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)") & (F.col("value") != ""))
    out = lines.select(chrom(F.get(f, k)).alias("chrom"), F.get(f, k + 1).try_cast("long").alias("start"), F.get(f, k + 2).try_cast("long").alias("end"), *[F.get(f, k + 3 + i).alias(n) for i, n in enumerate(names)]).where("start is not null and end is not null")
    return out.where(F.col("chrom").isin(*map(str, range(1, 23)), "X", "Y", "MT")) if canonical else out


def read_fasta(spark: SparkSession, path: str, length: int = 1000) -> DataFrame:
    """chrom, chunk_id, seq: a FASTA file as chunks of equal length, keyed for joins.

    A record is a file's text between headers; whole-genome files should be
    one file for each chromosome.
    """
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.regexp_replace(F.substring("value", F.length(head) + 1, F.length("value")), r"\s", "")
    r = records.select(chrom(F.get(F.split(F.trim(head), r"\s+"), 0)).alias("chrom"), seq.alias("s"))
    n = F.floor((F.length("s") - 1) / length)
    return r.where(F.length("s") > 0).select("chrom", "s", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk_id")).select("chrom", "chunk_id", F.substring("s", (F.col("chunk_id") * length + 1).cast("int"), F.lit(length)).alias("seq"))


def region(df: DataFrame, chrom_value: str, first: int, last: int, chrom_column: str = "chrom", pos: str = "pos") -> DataFrame:
    """Rows of a region, ends included; on Parquet partitioned by chromosome and sorted by position this reads the region only."""
    return df.where((F.col(chrom_column) == chrom_value) & F.col(pos).between(first, last))


def genotypes_to_long(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Long dosages from one row for each variant with arrays of allele pairs (g1, g2); missing alleles give null."""
    pairs = F.arrays_zip("g1", "g2")
    names = F.array(*[F.lit(s) for s in samples])
    rows = df.select("zarr_idx", F.posexplode(pairs).alias("k", "g"))
    return rows.select("zarr_idx", F.get(names, F.col("k")).alias("sample_id"), genotype_dosage(F.col("g.g1"), F.col("g.g2")).alias("dosage"))


def long_to_arrays(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row for each variant with its samples' dosages in order; absent ones are null.

    A variant's known dosages are collected and the gaps between their places
    filled, so the plan doesn't grow with the samples.
    """
    places = df.sparkSession.createDataFrame([(i, str(s)) for i, s in enumerate(samples)], "place int, sample_name string")
    known = df.withColumn("sample_name", F.col("sample_id").cast("string")).join(places, "sample_name", "left")
    cells = known.groupBy("zarr_idx", "place").agg(F.first("dosage").alias("dosage"))
    lists = cells.groupBy("zarr_idx").agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "dosage")))).alias("cells"))
    none = F.lit(None).cast(df.schema["dosage"].dataType)
    before = lambda i: F.coalesce(F.get("cells", i - 1)["place"], F.lit(-1))
    filled = F.flatten(F.transform("cells", lambda x, i: F.concat(F.array_repeat(none, x["place"] - before(i) - 1), F.array(x["dosage"]))))
    rest = F.array_repeat(none, F.lit(len(samples) - 1) - before(F.size("cells")))
    return lists.select("zarr_idx", F.concat(filled, rest).alias("dosages"))


def long_to_cells(df: DataFrame, block: int = 1 << 14) -> DataFrame:
    """One row for each variant and block of sample numbers with arrays of its known dosages and their samples, sample_ids and dosages.

    Absent and null dosages take no place, so rows grow with what is known and
    not with the samples there are, and no header of all samples is needed.
    Samples are whole numbers; one that comes again has a place for each time.
    """
    cell = F.collect_list(F.struct("sample_id", "dosage")).alias("cells")
    rows = df.where("dosage is not null").groupBy("zarr_idx", F.floor(F.col("sample_id") / F.lit(block)).alias("_block")).agg(cell)
    return rows.select("zarr_idx", F.col("cells.sample_id").alias("sample_ids"), F.col("cells.dosage").alias("dosages"))


def variant_catalog(df: DataFrame) -> DataFrame:
    """Catalog rows from variants with an allele array: index, position, REF and first ALT."""
    return df.select("CHROM", "zarr_idx", "POS", F.get("alleles", 0).alias("REF"), F.get("alleles", 1).alias("ALT"))
