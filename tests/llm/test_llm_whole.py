"""What is learned comes from the rows that are there."""

from pyspark.sql import functions as F

from variantframe.llm import toxicity


def test_labels_of_missing_documents_take_no_place(spark, monkeypatch):
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.orderBy(F.xxhash64("doc_id").desc()).limit(60).select("doc_id", F.concat(F.lit("text "), "doc_id").alias("text"))
    there = {r[0] for r in docs.select("doc_id").collect()}
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.extend(rows))
    toxicity.fit(docs, labels, sample=5)
    assert sorted(label for _, label in seen) == [0] * 10 + [1] * 5
    assert {int(text.split()[1]) for text, _ in seen} <= there
