"""Role tables: the driver's tables cast as variants, weights, dosages, samples ...

Each role is SQL in the dialect that Spark and DuckDB share, so the query and
its oracle start from the same rows.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

ROLES: dict[str, str] = {
    "catalog": """SELECT p_partkey AS zarr_idx, p_brand AS CHROM, p_partkey AS POS, substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS REF,
        substr('ACGT', CAST((p_partkey % 4 + 1 + CAST(floor(p_partkey / 4.0) AS BIGINT) % 3) % 4 + 1 AS INT), 1) AS ALT FROM part""",
    "weights": """SELECT zarr_idx AS rowid, CHROM, CASE WHEN zarr_idx % 11 = 0 THEN POS + 100000000 ELSE POS END AS POS,
        CASE zarr_idx % 5 WHEN 0 THEN ALT WHEN 1 THEN REF WHEN 2 THEN translate(ALT, 'ACGT', 'TGCA') WHEN 3 THEN translate(REF, 'ACGT', 'TGCA') ELSE 'N' END AS EA,
        CASE zarr_idx % 5 WHEN 0 THEN REF WHEN 1 THEN ALT WHEN 2 THEN translate(REF, 'ACGT', 'TGCA') WHEN 3 THEN translate(ALT, 'ACGT', 'TGCA') ELSE 'A' END AS OA,
        CAST(zarr_idx % 2 AS INT) AS IS_FLIP, CAST(zarr_idx % 997 AS DOUBLE) * 1.0013713e-3 - 4e-1 AS BETA FROM catalog WHERE zarr_idx % 3 = 0""",
    "dosage": "SELECT l_partkey AS zarr_idx, o_custkey AS sample_id, CAST(CAST(l_quantity AS BIGINT) % 3 AS DOUBLE) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "dosage_gaps": """SELECT l_partkey AS zarr_idx, o_custkey AS sample_id,
        CASE WHEN CAST(l_quantity AS BIGINT) % 7 = 6 OR l_partkey % 50 = 7 THEN NULL ELSE CAST(CAST(l_quantity AS BIGINT) % 3 AS DOUBLE) END AS dosage
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "scores": "SELECT c_custkey AS sample_id, CAST(c_custkey % 2 AS INT) AS sex, CAST(floor(c_acctbal / 5e1) * 50 AS DOUBLE) AS prs, c_acctbal AS raw, CASE WHEN c_custkey % 3 = 0 OR c_acctbal > 6e3 AND c_custkey % 5 < 3 THEN 1 ELSE 0 END AS status FROM customer",
    "annotated": """SELECT l_suppkey AS PRS_ID, p_brand AS CHROM, l_partkey * 1000 + l_orderkey % 1000 AS POS, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS EFFECT_ALLELE,
        concat(p_type, CAST(l_partkey % 20 AS STRING)) AS gene_name, concat(p_type, CAST(l_partkey % 20 AS STRING), ',', p_type, CAST(l_orderkey % 20 AS STRING)) AS all_overlapping_genes,
        CASE CAST(l_quantity AS BIGINT) % 8 WHEN 0 THEN 'stop_gained' WHEN 1 THEN 'missense_variant' WHEN 2 THEN 'synonymous_variant' WHEN 3 THEN 'splice_region_variant'
          WHEN 4 THEN 'intron_variant' WHEN 5 THEN 'upstream_gene_variant' WHEN 6 THEN 'inframe_deletion' ELSE 'intergenic_variant' END AS consequence,
        CASE CAST(l_discount * 100 AS BIGINT) % 5 WHEN 0 THEN 'common' WHEN 1 THEN 'rare' WHEN 2 THEN 'novel' WHEN 3 THEN 'ultra_rare' ELSE 'low_frequency' END AS rarity_class,
        (l_extendedprice - 5e4) / 1e3 AS BETA, l_discount AS af, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS cadd,
        CASE WHEN l_linenumber = 7 THEN 'NA' ELSE CAST(l_quantity AS STRING) END AS cadd_phred, l_tax * 10 AS revel_score, l_returnflag = 'R' AS is_lof,
        CASE l_linestatus WHEN 'O' THEN 'promoter' ELSE '' END AS regulatory_element_type, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "clinical": "SELECT DISTINCT upper(concat(p_type, CAST(p_partkey % 20 AS STRING))) AS gene_symbol, CASE WHEN p_partkey % 20 < 5 THEN 'high' ELSE 'medium' END AS confidence FROM part WHERE p_partkey % 20 IN (1, 3, 8, 13)",
    "points": "SELECT event_id AS point_id, event_type AS CHROM, (event_id * 7919) % 200000 AS pos FROM events",
    "intervals": """SELECT p_partkey AS iv, CASE p_partkey % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'signup' WHEN 2 THEN 'click' ELSE 'error' END AS CHROM,
        (p_partkey * 613) % 200000 AS b, (p_partkey * 613) % 200000 + p_size * CASE WHEN p_partkey % 40 = 0 THEN 900 ELSE 15 END AS e FROM part""",
    "gwas_f": """SELECT p_brand AS CHROM, p_partkey AS POS, substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS A0, substr('ACGT', CAST((p_partkey + 1) % 4 + 1 AS INT), 1) AS A1,
        CAST(p_size AS DOUBLE) / 1e3 - 2e-2 AS BETA, CAST(p_size % 7 AS DOUBLE) / 1e2 AS SE, CAST(100 + p_partkey % 50 AS DOUBLE) AS N, CAST(p_partkey % 100 AS DOUBLE) / 1e2 AS FREQ FROM part WHERE p_partkey % 2 = 0""",
    "gwas_m": """SELECT p_brand AS CHROM, p_partkey AS POS, substr('ACGT', CAST(p_partkey % 4 + 1 AS INT), 1) AS A0, substr('ACGT', CAST((p_partkey + 1) % 4 + 1 AS INT), 1) AS A1,
        CAST(p_retailprice AS DOUBLE) / 1e5 - 1e-2 AS BETA, CAST(1 + p_size % 5 AS DOUBLE) / 1e2 AS SE, CAST(80 + p_partkey % 70 AS DOUBLE) AS N, CAST(p_partkey % 90 AS DOUBLE) / 1e2 AS FREQ FROM part WHERE p_partkey % 3 = 0""",
    "hits": "SELECT l_partkey AS SNP, p_brand AS CHROM, l_partkey * 100 + l_linenumber AS GENPOS, p_type AS gene, CAST(l_suppkey % 3 AS INT) AS dataset, (l_tax + 1e-3) * l_discount / l_extendedprice AS P, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey",
    "cohort": """SELECT c_custkey AS PATID, CAST(30 + c_custkey % 60 AS INT) AS AGE, CAST(c_custkey % 2 AS INT) AS MALE,
        CASE WHEN c_custkey % 17 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN NULL ELSE 0 END AS BASE_OTHCANCER, CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS BASE_ORALCANCER,
        CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS BASE_STOMCANCER, CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS BASE_CERVCANCER,
        CASE WHEN c_custkey % 31 = 0 THEN 1 WHEN c_custkey % 5 = 0 THEN NULL ELSE 0 END AS BASE_PROSTATECANCER, CASE WHEN c_custkey % 37 = 0 THEN 1 ELSE 0 END AS BASE_LUNGCANCER,
        CASE WHEN c_custkey % 41 = 0 THEN 1 ELSE 0 END AS BASE_BREASTCANCER, CASE WHEN c_custkey % 7 = 0 THEN 1 WHEN c_custkey % 3 = 0 THEN NULL ELSE 0 END AS D040,
        CASE c_custkey % 13 WHEN 0 THEN 'C33' WHEN 1 THEN 'C349' WHEN 2 THEN 'C50' WHEN 3 THEN 'C169' WHEN 4 THEN 'C76' WHEN 5 THEN 'C81' WHEN 6 THEN 'D32' WHEN 7 THEN 'C5'
          WHEN 8 THEN 'CXX' WHEN 9 THEN '' WHEN 10 THEN NULL WHEN 11 THEN 'C61' ELSE 'c53' END AS ICD10_UNDERLYING,
        CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '4' WHEN 2 THEN '5|6' ELSE '6' END AS EXOME_MCPS_FLAG FROM customer""",
    "link_left": """SELECT o_orderkey AS left_id, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey AS STRING) END AS link_id, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 2 AS INT) AS sex,
        CAST(150 + o_orderkey % 40 AS INT) AS height, CAST(50 + o_orderkey % 50 AS INT) AS weight, CAST(40 + o_custkey % 30 AS INT) AS age, CAST(1950 + o_custkey % 30 AS INT) AS birth_year FROM orders WHERE o_orderkey % 2 = 0""",
    "link_right": """SELECT o_orderkey AS right_id, CAST(o_custkey AS STRING) AS link_id, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 2 AS INT) AS sex,
        CAST(150 + o_orderkey % 37 AS INT) AS height, CAST(50 + o_orderkey % 47 AS INT) AS weight, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(40 + o_custkey % 31 AS INT) END AS age,
        CAST(1950 + o_custkey % 29 AS INT) AS birth_year FROM orders WHERE o_orderkey % 2 = 1""",
    "props": "SELECT event_id, event_type, props, ts FROM events",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def needed(sql: str, seen: tuple[str, ...] = ()) -> list[str]:
    """Roles that a text uses, those they use first."""
    out: list[str] = []
    for r in ROLES:
        if r not in seen and re.search(rf"\b{r}\b", sql):
            for x in [*needed(ROLES[r], (*seen, r)), r]:
                if x not in out:
                    out.append(x)
    return out


def oracle(sql: str, roles: str = "") -> str:
    """A DuckDB query with its roles as common table expressions."""
    names = needed(" ".join(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql)) + " " + roles)
    with_ = ", ".join(f"{n} AS ({ROLES[n]})" for n in names)
    body = sql.strip()
    if not with_:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {body[15:]}"
    return f"WITH {with_}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {with_} {body}"


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role table, or one of the driver's tables, of a scale directory."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    prefix = f"vf_{zlib.crc32(sf_dir.encode()):08x}_"
    sql = ROLES[name]
    for t in [*TABLES, *ROLES]:
        if t != name and re.search(rf"(?:FROM|JOIN)\s+{t}\b", sql):
            role(spark, sf_dir, t).createOrReplaceTempView(prefix + t)
            sql = re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\g<1>{prefix}{t}", sql)
    return spark.sql(sql)
