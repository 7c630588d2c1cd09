"""Registered queries of the corpus operators: each applies its operator, with
production parameters, to its whole table and derives the result columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_automaton, html_extract, language, minhash, mixing, oracles, quality, token_counts, toxicity, url_filter
from .common import crc_mod

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    figures = quality.text_figures(docs, keep_text=False)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(figures).select("doc_id", *[f"figures.{c}" for c in base], "quality.base_failed", "quality.kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    scored = toxicity.toxicity(docs, model, into="score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), k=10)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    found = language.identify(docs.select("doc_id", "text"), model, into="language", spans=False)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mixture(docs)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), into="main_text")
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes)
    counted = token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json"), into="n_tokens", keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def digests(csv: str, decoded: bytes) -> dict:
    return {
        "n_tokens": csv.count(",") + 1 if csv else 0,
        "ids_sha256": hashlib.sha256(csv.encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest(),
    }


DIGESTS = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_DDL = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_automaton.bpe_codec(docs, tokenizer_path("byte_bpe_50k.json"), into="bpe", derive=digests, ddl=DIGESTS_DDL, arrow=DIGESTS)
    return done.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_cross_polytope": op3_cross_polytope,
    "op4_language": op4_language,
    "op5_mixing": op5_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_html_extract": op7_html_extract,
    "op8_token_counts": op8_token_counts,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_bpe_roundtrip": op10_bpe_roundtrip,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.OP1_SQL,
    "op5_mixing": oracles.OP5_SQL,
    "op9_minhash_near_dedup": oracles.OP9_SQL,
}
