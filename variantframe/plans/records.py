"""Queries on records, catalogs and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from variantframe.functions import scalars
from variantframe.sources import catalog, records
from variantframe.sources.genomics import split_cpra

from .common import Book, rounded

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.add("json_flatten", "SELECT event_id, (props ->> '$.k')::BIGINT AS \"props.k\" FROM events")
def _flatten(r):
    e = r("events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return records.flatten(e)


@book.add("json_safe", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events")
def _safe(r):
    return records.json_safe(r("events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")))


@book.add("upsert_catalog", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN round(c_acctbal + 1, 6) ELSE round(c_acctbal, 6) END AS value FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name, round(s_acctbal, 6) FROM supplier")
def _upsert(r):
    old = r("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    new = old.where("id % 3 = 0").select("id", F.concat(F.lit("new"), "id").alias("name"), F.when(F.col("id") % 2 == 0, F.col("value") + 1).alias("value"))
    more = r("supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))
    return rounded(catalog.upsert(old, new.unionByName(more), ["id"]))


@book.add("ttl_read", "SELECT event_id FROM events WHERE TIMESTAMP '2024-01-20 00:00:00' - ts < INTERVAL 3 DAY")
def _ttl(r):
    return catalog.alive(r("events"), "ts", 3 * 86400, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("event_id")


@book.add("split_cpra", "SELECT p_brand AS chrom, p_partkey AS pos, 'A' AS ref, 'G' AS alt, p_size FROM part WHERE p_partkey % 3 = 0")
def _cpra(r):
    k = F.col("p_partkey") % 3
    brand = F.regexp_replace("p_brand", "#", "-")
    p = r("part").select(F.when(k == 0, F.concat_ws(":", brand, "p_partkey", F.lit("A"), F.lit("G"))).when(k == 1, F.concat_ws(":", brand, F.lit("x"), F.lit("A"), F.lit("G"))).otherwise(F.concat_ws(":", brand, "p_partkey", F.lit("A"))).alias("CPRA"), "p_size")
    return split_cpra(p).withColumn("chrom", F.regexp_replace(F.initcap(F.lower("chrom")), "-", "#"))


@book.add("tolerant_parsing", "SELECT p_partkey, p_size::VARCHAR AS d, (DATE '2020-01-01' + (p_partkey % 300)::INT) AS day, p_size + 0.5::DOUBLE AS x, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS sex FROM part")
def _parsing(r):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("p_partkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd-MM-yyyy"))
    return r("part").select(
        "p_partkey", scalars.digits(F.concat(F.lit("no. "), "p_size", F.lit(" cm"))).alias("d"), scalars.parse_date(text).alias("day"),
        scalars.clean_number(F.concat(F.lit("about "), "p_size", F.lit(",5 kg"))).alias("x"), scalars.sex_code(F.when(F.col("p_partkey") % 2 == 0, " m ").otherwise("Female")).alias("sex"),
    )


@book.add("info_map", "SELECT p_partkey, p_size::VARCHAR AS af, p_brand AS db FROM part")
def _info(r):
    m = scalars.info_map(F.concat(F.lit("AF="), "p_size", F.lit(";FLAG;DB="), "p_brand", F.lit(";AF=9")))
    return r("part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["AF"].alias("af"), F.col("m")["DB"].alias("db"))


@book.add("trait_names", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_name || ';' || p_type ELSE p_type END AS traits FROM part")
def _traits(r):
    k = F.col("p_partkey") % 4
    obj = F.to_json(F.array(F.struct(F.col("p_type").alias("label"))))
    text = F.when(k == 1, F.col("p_name")).when(k == 2, F.to_json(F.array("p_name", "p_type"))).when(k == 3, obj)
    return r("part").select("p_partkey", F.array_join(scalars.trait_names(text), ";").alias("traits"))


@book.add("id_patterns", "SELECT p_partkey, p_partkey % 2 = 0 AS pgs, p_partkey % 3 <> 0 AS gene FROM part")
def _patterns(r):
    k = F.col("p_partkey")
    pgs = F.when(k % 2 == 0, F.concat(F.lit("PGS"), F.lpad(k.cast("string"), 6, "0"))).otherwise(F.concat(F.lit("PGS"), k.cast("string"), F.lit("x")))
    gene = F.when(k % 3 == 0, F.lit("a b")).otherwise(F.concat(F.lit("GENE"), k.cast("string")))
    return r("part").select("p_partkey", scalars.pgs_id_valid(pgs).alias("pgs"), scalars.gene_symbol_valid(gene).alias("gene"))


@book.add("body_mass_index", "SELECT left_id, round(weight / (height / 100.0::DOUBLE) ** 2, 6) AS bmi FROM link_left")
def _bmi(r):
    return rounded(r("link_left").select("left_id", scalars.body_mass_index(F.col("weight"), F.col("height")).alias("bmi")))
