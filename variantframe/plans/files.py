"""Queries on reading and writing files: whole tables are written in a format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantframe.operators.annotation import chunk_bases
from variantframe.operators.common import shared_folder
from variantframe.sources import delimited, genomics, records

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


def landing(df: DataFrame, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_folder(df.sparkSession)}/variantframe_files/{name}-{uuid.uuid4().hex}"


def put_lines(df: DataFrame, lines: Column, name: str, head: list[str] = (), tail: list[str] = (), compression: str = "none") -> str:
    """Text lines, with a head and a tail as files of their own."""
    path = landing(df, name)
    for part, extra in (("a", head), ("z", tail)):
        if extra:
            df.sparkSession.createDataFrame([("\n".join(extra),)], "value string").coalesce(1).write.text(f"{path}/part={part}", compression=compression)
    df.select(lines.alias("value")).write.text(f"{path}/part=m", compression=compression)
    return f"{path}/*"


def put_one_file(df: DataFrame, lines: Column, order: str, name: str, head: list[str], tail: list[str] = ()) -> str:
    """One file: head, lines in order, tail; such formats can't be split."""
    path = landing(df, name)
    all_ = df.select(F.lit(1).alias("k"), F.col(order).cast("long").alias("n"), lines.alias("value"))
    for k, extra in ((0, head), (2, tail)):
        if extra:
            all_ = all_.unionByName(df.sparkSession.createDataFrame([(k, i, x) for i, x in enumerate(extra)], "k int, n long, value string"))
    all_.coalesce(1).sortWithinPartitions("k", "n").select("value").write.text(path)
    return path


def tabbed(*columns) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


@book.add("csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey % 2 = 0")
def _csv(r):
    df = r("customer")
    delimited.write_text(df.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path := landing(df, "csv"), sep=",")
    return delimited.read_csv(df.sparkSession, path, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").where("c_nationkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal")


@book.add("csv_scan_inferred", "SELECT s_suppkey, s_name FROM supplier")
def _csv_inferred(r):
    df = r("supplier")
    delimited.write_text(df.select("s_suppkey", "s_name", "s_acctbal"), path := landing(df, "csv"), sep=",", compression="gzip")
    return delimited.read_csv(df.sparkSession, path, columns=["s_suppkey", "s_name"]).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@book.add("cadd_scan", "SELECT CAST(zarr_idx % 22 + 1 AS VARCHAR) AS CHR, POS::INT AS POS, REF, ALT, round(zarr_idx % 64 / 8.0::DOUBLE, 3) AS PHRED FROM catalog", "catalog")
def _cadd(r):
    c = r("catalog")
    path = put_lines(c, tabbed(F.col("zarr_idx") % 22 + 1, "POS", "REF", "ALT", F.lit(0.5), F.col("zarr_idx") % 64 / 8), "cadd", ["## made here", "#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED"], compression="gzip")
    return rounded(delimited.read_cadd(c.sparkSession, path).select("CHR", "POS", "REF", "ALT", F.col("PHRED").cast("double").alias("PHRED")), 3)


@book.add("betamap_scan", "SELECT POS, EA AS EFFECT_ALLELE, round(BETA, 6) AS BETA, IS_FLIP FROM weights WHERE CHROM = 'Brand#7'", "weights")
def _betamap(r):
    w = r("weights")
    out = w.select(F.lit("PGS1").alias("PRS_ID"), "CHROM", "POS", F.lit(None).cast("string").alias("ID"), F.col("EA").alias("EFFECT_ALLELE"), F.col("OA").alias("OTHER_ALLELE"), "BETA", "IS_FLIP")
    delimited.write_text(out, path := landing(w, "betamap"), places=8, compression="gzip")
    return rounded(delimited.read_betamap(w.sparkSession, path, "Brand#7").select("POS", "EFFECT_ALLELE", "BETA", F.col("IS_FLIP").cast("int").alias("IS_FLIP")))


@book.add("text_sink", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 4 = 0 THEN 'NA' ELSE printf('%.3f', (c_custkey % 1000) / 8.0::DOUBLE) END AS value FROM customer")
def _text(r):
    df = r("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 1000 / 8).alias("value"))
    delimited.write_text(df, path := landing(df, "text"), places=3, na="NA")
    return delimited.read_csv(df.sparkSession, path, "id string, value string", sep="\t")


@book.add("parquet_region", "SELECT zarr_idx, POS, REF FROM catalog WHERE CHROM = 'Brand#7' AND POS BETWEEN 100 AND 900", "catalog")
def _parquet(r):
    c = r("catalog")
    delimited.write_parquet(c, path := landing(c, "parquet"), compression="snappy", partition=["CHROM"], sort=["POS"])
    return genomics.region(delimited.read_parquet(c.sparkSession, path), "Brand#7", 100, 900, "CHROM", "POS").select("zarr_idx", "POS", "REF")


@book.add("parquet_merge", "SELECT s_suppkey AS id, s_name AS name, NULL::DOUBLE AS balance FROM supplier UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def _merge(r):
    s, c = r("supplier"), r("customer")
    path = landing(s, "merge")
    delimited.write_parquet(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), f"{path}/part=1")
    delimited.write_parquet(c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), f"{path}/part=2")
    return delimited.read_parquet(s.sparkSession, path, columns=["id", "name", "balance"], merge=True)


@book.add("scoring_file", "SELECT CHROM AS chrom, CAST(POS AS VARCHAR) AS pos, EA AS effect_allele, 'PGS000001' AS pgs_id, 301 AS header FROM weights", "weights")
def _scoring(r):
    w = r("weights")
    head = ["#pgs_id=PGS000001", "#genome_build=GRCh38", *[f"#note{i}=x" for i in range(299)], "hm_chr\thm_pos\trsID\teffect_allele\tother_allele\teffect_weight"]
    path = put_one_file(w, tabbed("CHROM", "POS", F.lit("."), "EA", "OA", "BETA"), "rowid", "scoring", head)
    df, meta = delimited.read_scoring(w.sparkSession, path)
    return df.select("chrom", "pos", "effect_allele", F.lit(meta["pgs_id"]).alias("pgs_id"), F.lit(len(meta)).alias("header"))


_HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]


def vcf(r):
    c = r("catalog")
    info = F.concat(F.lit("AF=0.25,"), F.col("zarr_idx") % 8 / 8, F.lit(";AN="), "zarr_idx", F.lit(";nhomalt=1,2;CLNSIG=Benign;RS=7;FLAG"))
    line = tabbed(F.concat(F.lit("chr"), F.col("zarr_idx") % 22 + 1), "POS", F.lit("."), "REF", F.concat("ALT", F.lit(",N")), F.lit("."), F.lit("PASS"), info, F.lit("AN:AC"), F.concat("zarr_idx", F.lit(":3,"), F.col("zarr_idx") % 5))
    return genomics.read_vcf(c.sparkSession, put_lines(c, line, "vcf", _HEAD, compression="gzip"), ["S1"])


_ALTS = "(SELECT CAST(zarr_idx % 22 + 1 AS VARCHAR) AS chrom, zarr_idx, POS, REF, k, CASE k WHEN 0 THEN ALT ELSE 'N' END AS ALT FROM catalog, range(2) t(k))"


@book.add("vcf_frequencies", f"SELECT chrom AS CHROM, POS, REF, ALT, CASE k WHEN 0 THEN 0.25 ELSE zarr_idx % 8 / 8.0 END::DOUBLE AS af, zarr_idx AS an, k + 1 AS nhomalt FROM {_ALTS}", "catalog")
def _vcf(r):
    return genomics.frequency_table(vcf(r), ("AF",))


@book.add("vcf_clinvar", f"SELECT chrom, POS AS pos, REF AS ref, ALT AS alt, 'Benign' AS clnsig, NULL::VARCHAR AS clndn, 'rs7' AS rsid FROM {_ALTS}", "catalog")
def _clinvar(r):
    table = genomics.clinvar_table(vcf(r))
    delimited.write_parquet(table, path := landing(table, "clinvar"), partition=["chrom"], sort=["pos"])
    return delimited.read_parquet(table.sparkSession, path).select(F.col("chrom").cast("string").alias("chrom"), "pos", "ref", "alt", "clnsig", "clndn", "rsid")


@book.add("vcf_samples", f"SELECT chrom, POS AS pos, ALT AS alt, zarr_idx AS an, CASE k WHEN 0 THEN 3 ELSE zarr_idx % 5 END AS ac FROM {_ALTS}", "catalog")
def _samples(r):
    an, ac = genomics.allele_counts(F.col("S1"), F.col("alt_index"))
    return vcf(r).select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.col("ALT").alias("alt"), an.alias("an"), ac.alias("ac"))


_GENE = "SELECT CAST(iv % 22 + 1 AS VARCHAR) AS CHROM, {f} AS feature, b AS begin, e AS \"end\", CASE WHEN iv % 2 = 0 THEN '+' ELSE '-' END AS strand, 'G' || (iv % 97) AS gene_id, 'N' || iv AS gene_name FROM intervals"


def features(r, kind: Column, attributes: Column) -> str:
    i = r("intervals")
    line = tabbed(F.concat(F.lit("chr"), F.col("iv") % 22 + 1), F.lit("src"), kind, F.col("b") + 1, "e", F.lit("."), F.when(F.col("iv") % 2 == 0, "+").otherwise("-"), F.lit("."), attributes)
    return put_lines(i, line, "features", ["##gff-version 3", "#!made here"])


@book.add("gff_scan", f"SELECT * FROM ({_GENE.format(f=chr(39).join(['CASE WHEN iv % 3 = 0 THEN ', 'gene', ' WHEN iv % 3 = 1 THEN ', 'CDS', ' ELSE ', 'region', ' END']))}) WHERE feature <> 'region'", "intervals")
def _gff(r):
    kind = F.when(F.col("iv") % 3 == 0, "gene").when(F.col("iv") % 3 == 1, "CDS").otherwise("region")
    path = features(r, kind, F.concat(F.lit("ID=x;gene_id=G"), F.col("iv") % 97, F.lit(";Name=N"), "iv"))
    return genomics.read_gff(r("intervals").sparkSession, path).select("CHROM", "feature", "begin", "end", "strand", "gene_id", "gene_name")


@book.add("gtf_genes", _GENE.format(f="'gene'"), "intervals")
def _gtf(r):
    path = features(r, F.lit("gene"), F.concat(F.lit('gene_id "G'), F.col("iv") % 97, F.lit('"; gene_name "N'), "iv", F.lit('";')))
    return genomics.read_gff(r("intervals").sparkSession, path, ["gene"], " ").select("CHROM", "feature", "begin", "end", "strand", "gene_id", "gene_name")


@book.add("bed_scan", "SELECT CAST(iv % 25 + 1 AS VARCHAR) AS chrom, b AS start, e AS \"end\", 'n' || iv AS name FROM intervals WHERE iv % 25 < 22", "intervals")
def _bed(r):
    i = r("intervals")
    name = F.when(F.col("iv") % 25 < 22, F.concat(F.lit("chr"), F.col("iv") % 25 + 1)).otherwise("chrUn_1")
    path = put_lines(i, tabbed(name, "b", "e", F.concat(F.lit("n"), "iv")), "bed", ["track name=x", "browser position chr1", "# c"])
    return genomics.read_bed(i.sparkSession, path)


@book.add("fasta_bases", "SELECT p_partkey, substr(repeat('ACGGT', 400), CAST((p_partkey * 37) % 1990 + 1 + p_partkey % 5 AS INT), 1) AS base FROM part")
def _fasta(r):
    p = r("part")
    records_ = p.sparkSession.range(5).select("id", F.concat(F.lit(">chr"), F.col("id") + 1, F.lit(" made\n"), F.regexp_replace(F.substring(F.expr("repeat('acggt', 401)"), (F.col("id") + 1).cast("int"), F.lit(2000)), "(.{60})", "$1\n")).alias("value"))
    path = put_one_file(records_, F.col("value"), "id", "fasta", [])
    chunks = genomics.read_fasta(p.sparkSession, path, 100)
    asked = p.select("p_partkey", (F.col("p_partkey") % 5 + 1).cast("string").alias("CHROM"), (F.col("p_partkey") * 37 % 1990).alias("pos"))
    return chunk_bases(asked, chunks, "pos", "base", 100).select("p_partkey", "base")


@book.add("genotype_arrays", "SELECT zarr_idx, s AS sample_id, CASE WHEN zarr_idx % 3 = s::INT THEN NULL ELSE (zarr_idx % 2 + s::INT % 2)::DOUBLE END AS dosage FROM catalog, (VALUES ('0'), ('1'), ('2'), ('3')) v(s)", "catalog")
def _genotypes(r):
    ids = ["0", "1", "2", "3"]
    z = F.col("zarr_idx")
    df = r("catalog").select("zarr_idx", F.array(*[F.when(z % 3 == i, -1).otherwise(z % 2).cast("int") for i in range(4)]).alias("g1"), F.array(*[F.lit(i % 2) for i in range(4)]).alias("g2"))
    return genomics.genotypes_to_long(df, ids)


@book.add("variant_catalog", "SELECT CHROM, zarr_idx, POS, REF, ALT FROM catalog", "catalog")
def _catalog(r):
    c = genomics.variant_catalog(r("catalog").select("CHROM", "zarr_idx", "POS", F.array("REF", "ALT", F.lit("N")).alias("alleles")))
    delimited.write_text(c, path := landing(c, "catalog"), sep=",")
    return delimited.read_csv(c.sparkSession, path, "CHROM string, zarr_idx long, POS long, REF string, ALT string")


@book.add("sectioned_genes", "SELECT DISTINCT p_type AS Gene FROM part")
def _sections(r):
    p = r("part")
    path = put_one_file(p, F.concat_ws(",", F.col("p_partkey").cast("string"), "p_type", F.lit("1")), "p_partkey", "sections", ["Title,x", "[Heading]", "a,b", "[Assay]", "IlmnID,Gene,Chr"], ["[Controls]", "9,NOPE,1"])
    return delimited.sectioned_column(p.sparkSession, path, "IlmnID", "Gene")


@book.add("json_sidecar", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def _sidecar(r):
    n = r("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    delimited.write_json(n, path := landing(n, "json"))
    return records.read_json(n.sparkSession, path, "id long, name string", multiline=False).select("id", "name")
