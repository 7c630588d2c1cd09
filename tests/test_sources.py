"""Readers, writers and catalogs on small files written here."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from variantframe.sources import catalog, delimited, genomics, records
from variantframe.streaming import catalog_stream


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def put(path, text):
    path.write_text(text)
    return str(path)


def test_delimited(spark, tmp_path):
    p = put(tmp_path / "a.csv", "id,x,y\n1,2,z\n2,,w\n")
    assert rows(delimited.read_csv(spark, p, columns=["id", "y"])) == [(1, "z"), (2, "w")]
    assert delimited.read_csv(spark, p, "id long, x double, y string").dtypes[1] == ("x", "double")
    with gzip.open(tmp_path / "cadd.tsv.gz", "wt") as f:
        f.write("## header\n#Chrom\tPos\tRef\tAlt\tRaw\tPHRED\n1\t10\tA\tG\t0.5\t12.5\n2\t11\tC\tT\t0.1\t1.0\n")
    assert rows(delimited.read_cadd(spark, str(tmp_path / "cadd.tsv.gz"))) == [("1", 10, "A", "G", 12.5), ("2", 11, "C", "T", 1.0)]
    b = put(tmp_path / "b.tsv", "PRS_ID\tCHROM\tPOS\tID\tEFFECT_ALLELE\tOTHER_ALLELE\tBETA\tIS_FLIP\nP\t1\t5\t\tA\tG\t0.5\t0\nP\t2\t6\trs1\tC\t\t-1\t1\n")
    assert rows(delimited.read_betamap(spark, b, "2").select("POS", "OTHER_ALLELE", "IS_FLIP")) == [(6, None, 1)]


def test_scoring_file(spark, tmp_path):
    p = put(tmp_path / "s.txt", "#pgs_id=PGS000001\n#genome_build=GRCh38\nhm_chr\thm_pos\trsID\teffect_allele\thm_inferOtherAllele\teffect_weight\n1\t10\trs1\tA\tG\t0.5\n1\t\t.\tC\tA/T\tNA\n")
    df, meta = delimited.read_scoring(spark, p)
    assert meta == {"pgs_id": "PGS000001", "genome_build": "GRCh38"}
    assert rows(df.select("chrom", "pos", "beta"), F.col("pos").isNull()) == [("1", "10", "0.5"), ("1", None, "NA")]


def test_parquet_merge_and_sinks(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, b double").write.parquet(str(tmp_path / "t/k=1"))
    spark.createDataFrame([(2, "x")], "a int, c string").write.parquet(str(tmp_path / "t/k=2"))
    assert rows(delimited.read_parquet(spark, str(tmp_path / "t"), columns=["a", "b", "c"], merge=True)) == [(1, 2.0, None), (2, None, "x")]
    df = spark.createDataFrame([("1", 5, 0.123456789), ("2", 6, None)], "CHROM string, POS int, x double")
    delimited.write_parquet(df, str(tmp_path / "o"), partition=["CHROM"], sort=["POS"])
    assert rows(genomics.region(spark.read.parquet(str(tmp_path / "o")).withColumn("CHROM", F.col("CHROM").cast("string")), "1", 0, 9, "CHROM", "POS").select("POS")) == [(5,)]
    delimited.write_text(df, str(tmp_path / "w"), places=4, na="NA")
    assert rows(spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "w"))) == [("1", "5", "0.1235"), ("2", "6", "NA")]
    delimited.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_file_listing_and_sections(spark, tmp_path):
    (tmp_path / "d").mkdir()
    put(tmp_path / "d/PGS000123_betamap.tsv", "x")
    put(tmp_path / "d/PGS000124_metadata.json", "{}")
    got = rows(delimited.list_files(spark, str(tmp_path / "d")).select("pgs_id", "kind"))
    assert got == [("PGS000123", "betamap"), ("PGS000124", "metadata")]
    p = put(tmp_path / "m.csv", "Title,x\n[Heading]\na,b\n[Assay]\nIlmnID,Gene,Chr\n1,BRCA1,17\n2,AR,X\n3,AR,X\n[Controls]\n9,NOPE,1\n")
    assert rows(delimited.sectioned_column(spark, p, "IlmnID", "Gene")) == [("AR",), ("BRCA1",)]


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMN1
chr1\t10\trs5\tA\tG,T\t.\tPASS\tAF=0.1,0.2;AN=100;nhomalt=1,.;DB;CLNSIG=Benign;RS=77\tAN:AC\t200:5,7
chrM\t3\t.\tC\tA\t.\t.\tAF=.\tAN:AC\t.:.
"""


def test_vcf(spark, tmp_path):
    df = genomics.read_vcf(spark, put(tmp_path / "a.vcf", VCF), ["SAMN1"])
    an, ac = genomics.allele_counts(F.col("SAMN1"), F.col("alt_index"))
    assert rows(df.select("CHROM", "POS", "ALT", an.alias("an"), ac.alias("ac"))) == [("1", 10, "G", 200, 5), ("1", 10, "T", 200, 7), ("MT", 3, "A", None, None)]
    f = rows(genomics.frequency_table(df, ["AF"]).select("ALT", "af", "an", "nhomalt"))
    assert f == [("A", None, None, None), ("G", 0.1, 100, 1), ("T", 0.2, 100, None)]
    c = rows(genomics.clinvar_table(df).select("alt", "clnsig", "rsid"))
    assert c == [("A", None, None), ("G", "Benign", "rs77"), ("T", "Benign", "rs77")]


def test_gff_bed_fasta(spark, tmp_path):
    g = put(tmp_path / "a.gff3", "##gff\nchr1\tS\tgene\t11\t20\t.\t+\t.\tID=g1;gene_id=G1;gene_name=AB;gene_type=protein_coding\nchr1\tS\tregion\t1\t99\t.\t+\t.\tID=r\nchr23\tS\tCDS\t5\t9\t.\t-\t0\tgene_id=G2;transcript_id=T2\n")
    assert rows(genomics.read_gff(spark, g).select("CHROM", "feature", "begin", "end", "gene_name", "transcript_id")) == [("1", "gene", 10, 20, "AB", None), ("X", "CDS", 4, 9, None, "T2")]
    t = put(tmp_path / "a.gtf", 'chr2\tS\tgene\t11\t20\t.\t+\t.\tgene_id "G9"; gene_name "Q";\n')
    assert rows(genomics.read_gff(spark, t, ["gene"], " ").select("gene_id", "gene_name", "begin")) == [("G9", "Q", 10)]
    b = put(tmp_path / "a.bed", "track x\n#c\nchr1\t5\t9\tPLS\nchrUn\t1\t2\tz\n")
    assert rows(genomics.read_bed(spark, b)) == [("1", 5, 9, "PLS")]
    u = put(tmp_path / "u.txt", "585\tchr2\t7\t8\tn\n")
    assert rows(genomics.read_bed(spark, u, bin_column=True)) == [("2", 7, 8, "n")]
    fa = put(tmp_path / "a.fa", ">chr1 first\nACGTA\nCG\n>2\nTT\n")
    assert rows(genomics.read_fasta(spark, fa, 4)) == [("1", 0, "ACGT"), ("1", 1, "ACG"), ("2", 0, "TT")]


def test_cpra_and_dosages(spark):
    df = spark.createDataFrame([("chr1:5:A:G", 0.1), ("1:5:A", 0.2), ("1:5:A:G:x", 0.3), ("1:q:A:G", 0.4)], "CPRA string, af double")
    assert rows(genomics.split_cpra(df)) == [("1", 5, "A", "G", 0.1)]
    g = spark.createDataFrame([(1, [0, 1, -1], [1, 1, 0])], "zarr_idx long, g1 array<int>, g2 array<int>")
    long = genomics.genotypes_to_long(g, ["a", "b", "c"])
    assert rows(long) == [(1, "a", 1.0), (1, "b", 2.0), (1, "c", None)]
    assert rows(genomics.long_to_arrays(long, ["c", "a"])) == [(1, [None, 1.0])]
    v = spark.createDataFrame([("1", 3, 9, ["A", "G", "T"])], "CHROM string, zarr_idx long, POS long, alleles array<string>")
    assert rows(genomics.variant_catalog(v)) == [("1", 3, 9, "A", "G")]


def test_records(spark, tmp_path):
    p = put(tmp_path / "r.json", json.dumps({"id": 1, "a": {"b": "x", "c": [1, 2], "d": {"e": None}}, "l": [{"k": 1}], "m": []}))
    got = records.flatten(records.read_json(spark, p, "id int, a struct<b: string, c: array<int>, d: struct<e: string>>, l array<struct<k: int>>, m array<string>")).first().asDict()
    assert got == {"id": 1, "a.b": "x", "a.c": "1; 2", "a.d.e": None, "l": '[{"k":1}]', "m": ""}
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.5, 3)], "x double, k int")
    assert [json.loads(r[0]) for r in records.as_json(df).collect()] == [{"k": 1}, {"k": 2}, {"x": 2.5, "k": 3}]


def test_catalog(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, t string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, "w"), ("c", 4, "v")], "id string, n int, t string")
    assert rows(catalog.upsert(old, new, ["id"], latest=F.col("n"))) == [("a", 1, "x"), ("b", 2, "z"), ("c", 4, "v")]
    assert rows(catalog.upsert(old, new, ["id"], keep=["t"], latest=F.col("n")))[1] == ("b", 2, "y")
    t = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:59:00")], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(catalog.alive(t, "ts", 600, F.lit("2024-01-01 01:00:00").cast("timestamp")).select("id")) == [("b",)]
    for _ in range(2):
        catalog.append_log(old, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_catalog_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "id string, n int"
    for i, text in enumerate(['{"id":"a","n":1}\n{"id":"b","n":2}\n', '{"id":"b","n":5}\n{"id":"c","n":3}\n']):
        put(src / f"{i}.json", text)
        q = catalog_stream.sync(catalog_stream.read_stream(spark, str(src), schema), str(tmp_path / "t"), ["id"], str(tmp_path / "cp"))
        assert q.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "t/v2"))) == [("a", 1), ("b", 5), ("c", 3)]


def test_excel_needs_a_reader(spark, tmp_path):
    pytest.importorskip("openpyxl")
    import pandas as pd

    pd.DataFrame({"a": ["1", None]}).to_excel(tmp_path / "x.xlsx", index=False)
    assert rows(delimited.read_excel(spark, str(tmp_path / "x.xlsx"))) == [(None,), ("1",)]


def test_time_to_live_counts_parts_of_a_second(spark):
    t = spark.createDataFrame([("a", "2024-01-17 00:00:00"), ("b", "2024-01-17 00:00:00.000001"), ("c", "2024-01-17 00:00:00.9"), ("d", None)], "id string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert rows(catalog.alive(t, "ts", 3 * 86400, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("id")) == [("b",), ("c",)]
