"""Token counts without token ids.

A pre-token is a run of characters without white space; the tokenizer splits it
further, but never joins across white space.  Three steps:

1. The table of distinct pre-tokens of all texts, with their frequencies; the
   pieces of each are counted once, where the table is made.
2. Each document's pre-token frequencies meet the table.  Its frequent head, of
   bounded size, travels to every worker, so most of a document's pre-tokens
   are joined where its frequencies are made, and only rare ones are sent.
3. Rare pre-tokens are joined with the table's rest and summed by document.
   They are rare, so no key of that join is hot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, least_frequency, limit_threads, ship, store

#: Separators that Python's split() knows and the tokenizer does not take as white space.
_ODD = re.compile("[\x1c-\x1f]")
_RUNS = re.compile("[^\t-\r \x85\xa0  -     　]+")
#: Most pre-tokens of the head that every worker holds.
HEAD = 250_000
#: Pre-tokens that a task gathers before it hands them on.
GATHERED = 300_000
#: Pre-tokens whose pieces are counted in one call.
BLOCK = 2048

TAIL = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
COUNTED = pa.struct([("known", pa.int64()), ("rare", TAIL)])
COUNTED_DDL = "struct<known: bigint, rare: array<struct<word: string, n: bigint>>>"


def pre_tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return _RUNS.findall(text) if _ODD.search(text) else text.split()


def _load(spec: str):
    limit_threads()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pre-tokens of a task's texts and their frequencies; some come more than once."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    seen: Counter[str] = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            seen.update(pre_tokens(text))
        if len(seen) > GATHERED:
            yield batch()
            seen.clear()
    yield batch()


def pre_token_table(df: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """word, n (its frequency in all texts) and pieces (its number of tokens) of every distinct pre-token."""

    @F.arrow_udf("long")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = hold(("token_counts", hash(spec)), lambda: _load(spec))
        for batch in batches:
            out: list[int] = []
            for i in range(0, len(batch), BLOCK):
                out += map(len, tok.encode_batch_fast(batch.slice(i, BLOCK).to_pylist(), add_special_tokens=False))
            yield pa.array(out, pa.int64())

    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(_gather, "word string, n bigint")
    counted = found.groupBy("word").agg(F.sum("n").alias("n"))
    return store(counted.withColumn("pieces", pieces.asNondeterministic()("word")), "pre_tokens")


def count_block(texts: list[str | None], pieces: dict[str, int]) -> tuple[list[int], list[list[tuple[str, int]]]]:
    """Pieces of each text's pre-tokens that are in ``pieces``, and the others with their frequencies."""
    known, rare = [], []
    for text in texts:
        freq = Counter(pre_tokens(text))
        try:
            known.append(sum([pieces[w] * n for w, n in freq.items()]))
            rare.append([])
        except KeyError:
            known.append(sum([pieces[w] * n for w, n in freq.items() if w in pieces]))
            rare.append([(w, n) for w, n in freq.items() if w not in pieces])
    return known, rare


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens", keep_text: bool = True, head: int = HEAD) -> DataFrame:
    """Add the number of tokens of each whole text, as the `tokenizers` library counts them.

    ``tokenizer`` is the path of the library's JSON file on the driver; its
    content travels with the function.  The pre-tokenizer of the file must drop
    white space (a word-level vocabulary); pre-tokens are then independent of
    their neighbours.  Special strings inside a text count as the library's
    default has it.  Null and empty texts count 0; very long texts are counted
    whole; repeated rows are counted each; an empty table stays empty; other
    columns are kept, and ``into`` gets underscores if the name is taken.  The
    result is stored, without the text if ``keep_text`` is false.  ``head``
    changes where pre-tokens are joined and no result.
    """
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    table = pre_token_table(df, spec, text)
    least = least_frequency(table, head)
    frequent = spark.sparkContext.broadcast({r["word"]: r["pieces"] for r in table.where(F.col("n") >= least).select("word", "pieces").toLocalIterator()})  # at most `head` rows

    @F.arrow_udf(COUNTED_DDL)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = frequent.value
        for batch in batches:
            known, rare = count_block(batch.to_pylist(), pieces)
            yield pa.StructArray.from_arrays([pa.array(known, pa.int64()), pa.array([[{"word": w, "n": n} for w, n in x] for x in rare], TAIL)], fields=list(COUNTED))

    into = fresh(df, into)
    row, made = fresh(df, "row_"), fresh(df, "counted_")
    kept = [F.col(f"`{c}`") for c in df.columns if keep_text or c != text]
    counted = df.withColumn(made, count.asNondeterministic()(F.col(text))).select(*kept, F.col(made), F.monotonically_increasing_id().alias(row))
    counted = store(counted, "counted")  # rows keep their numbers from here on
    rare = counted.select(F.col(row).alias("at"), F.explode(f"{made}.rare").alias("x")).select("at", "x.word", "x.n")
    rest = table.where(F.col("n") < least).select("word", "pieces")
    more = rare.join(rest, "word").groupBy("at").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    total = F.col(f"{made}.known") + F.coalesce(F.col("_more.more"), F.lit(0))
    joined = counted.join(more.alias("_more"), F.col(row) == F.col("_more.at"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns if c not in (row, made)], total.alias(into))
