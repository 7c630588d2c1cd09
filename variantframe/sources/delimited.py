"""Readers and writers of delimited text, Parquet and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantframe.functions.columns import SCORING_ROLES, resolve_columns
from variantframe.schemas import BETAMAP, CADD


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",", columns: Sequence[str] | None = None, header: bool = True, comment: str | None = None) -> DataFrame:
    """Delimited text with a header; ``columns`` prunes, ``schema`` avoids the pass that infers types."""
    r = spark.read.option("header", header).option("sep", sep)
    r = r.option("comment", comment) if comment else r
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    df = r.csv(path)
    return df.select(*columns) if columns else df


def read_positional(spark: SparkSession, path: str, schema: str, sep: str = "\t", comment: str = "#") -> DataFrame:
    """Headerless text with comment lines, columns named and typed by place."""
    return spark.read.option("sep", sep).option("comment", comment).schema(schema).csv(path)


def read_cadd(spark: SparkSession, path: str) -> DataFrame:
    raw = read_positional(spark, path, "c string, p int, r string, a string, raw float, phred float")
    names = [c.split(" ")[0] for c in CADD.split(", ")]
    return raw.select(F.col("c"), F.col("p"), F.col("r"), F.col("a"), F.col("phred")).toDF(*names)


def read_betamap(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t").option("enforceSchema", False).schema(BETAMAP).csv(path)
    return df.where(F.col("CHROM") == chrom) if chrom else df


def read_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, merge: bool = False) -> DataFrame:
    """Parquet files or globs; ``merge`` unites columns by name over files of different schemas."""
    df = spark.read.option("mergeSchema", merge).parquet(*paths)
    return df.select(*columns) if columns else df


def scoring_header(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str]]:
    """`#key=value` pairs and the column names of a scoring file: its comment lines, however many, and its first other line."""
    text = spark.read.text(path)
    pairs: dict[str, str] = {}
    for row in text.where(F.col("value").startswith("#") & F.contains("value", F.lit("="))).collect():  # a header's lines
        key, _, value = row[0].lstrip("#").partition("=")
        pairs.setdefault(key.strip(), value.strip())
    first = text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    return pairs, first[0].split("\t") if first else []


def read_scoring(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Weights of a scoring file by role (chrom, pos, id, effect_allele, other_allele, beta) as text, and its header."""
    meta, names = scoring_header(spark, path)
    roles = resolve_columns(names, SCORING_ROLES, ("chrom", "pos", "effect_allele", "beta"))
    raw = spark.read.option("sep", "\t").option("comment", "#").option("header", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return raw.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()]), meta


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", partition: Sequence[str] = (), mode: str = "overwrite", sort: Sequence[str] = ()) -> None:
    """Parquet by Spark's committer, which leaves a success mark; sorted rows let readers skip row groups."""
    df = df.sortWithinPartitions(*sort) if sort else df
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def format_float(c: Column, places: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c))


def write_text(df: DataFrame, path: str, sep: str = "\t", places: int | None = None, na: str = "", compression: str | None = None) -> None:
    """Delimited text with a header, floats in fixed places, a token for nulls."""
    if places is not None:
        df = df.select(*[format_float(F.col(f"`{c}`"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
    w = df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", na).option("emptyValue", na)
    (w.option("compression", compression) if compression else w).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A small table of metadata as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modified of files below a folder, with an id and a kind told by the name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike(r"(?i)_annot"), "annotation").when(name.rlike(r"(?i)betamap"), "betamap").when(name.rlike(r"(?i)metadata.*\.json$"), "metadata").when(name.rlike(r"(?i)\.(tsv|csv|parquet)(\.gz)?$"), "scores").otherwise("other")
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.nullif(F.regexp_extract(name, r"(PGS\d{6})", 1), F.lit("")).alias("pgs_id"), kind.alias("kind"))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet, read on the driver (such sheets are small); needs an Excel reader for pandas."""
    import pandas as pd

    pdf = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns))


def sectioned_column(spark: SparkSession, path: str, header_word: str, column: str) -> DataFrame:
    """Distinct values of a column in a file whose header line stands somewhere inside, told by a word in it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    head = lines.where(F.col("line").contains(header_word)).orderBy("n").first()
    if head is None:
        return spark.createDataFrame([], f"`{column}` string")
    at = [c.strip() for c in head["line"].split(",")].index(column)
    body = lines.where(F.col("n") > head["n"])
    end = body.where(F.col("line").startswith("[")).agg(F.min("n")).first()[0]
    body = body.where(F.col("n") < end) if end is not None else body
    return body.select(F.trim(F.get(F.split("line", ","), at)).alias(column)).where(F.col(column) != "").distinct()
