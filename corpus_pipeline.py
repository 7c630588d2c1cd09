"""The corpus pipeline: documents to encoded training text, in five stages.

Each stage takes the rows that the one before has kept and returns the columns
of its input; the last returns each emitted document's token ids and the text
they decode to, as digests and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantframe.llm import bpe_automaton, minhash, mixing, quality, queries, toxicity
from variantframe.llm.common import fresh


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base filter and that the quality rules find good."""
    return quality.filter_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not found toxic; learned from a bounded sample of the labels of documents that are left."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    score = fresh(docs, "toxicity")
    return toxicity.toxicity(docs, model, into=score).where(F.col(score) < 0.5).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate and their draw say."""
    mixed = mixing.mixture(docs, into=(name := fresh(docs, "mix")))
    return mixing.emit(mixed, name)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each emitted document encoded and decoded again."""
    done = bpe_automaton.bpe_codec(
        docs.select("doc_id", "text", "source"),
        queries.tokenizer_path("byte_bpe_50k.json"),
        into="bpe",
        derive=queries.digests,
        ddl=queries.DIGESTS_DDL,
        arrow=queries.DIGESTS,
    )
    return done.select("doc_id", "source", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The toxicity model and the automaton have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
