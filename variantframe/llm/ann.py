"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a
fast Hadamard transform) and fall to the nearest signed axis; a table's bucket
is the axis of one or two rotations.  A query probes a table's buckets in the
order of its coordinates.  Candidates of the probed buckets are reranked by
exact distances on the original vectors.

How many rotations and probes is fitted, not set: a bounded sample of the
queries is compared with all rows, and the cheapest index is taken that finds
the wanted share of their true neighbours.  A query that finds fewer than k
neighbours is compared with all rows.

Equal vectors are one class, of which only the smallest ids can be among the
nearest.  Queries and classes meet by bucket in blocks of bounded size, and a
block gives only its nearest, so no row is made for a mere candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, store

#: Classes and queries of a block.
BLOCK, QUERIES = 4096, 2048
#: Queries that are compared with all rows to fit the index, and rows that the share of candidates is estimated on.
SAMPLE, ROWS = 100, 2000
#: Share of the sampled queries' true neighbours that the index must find.
RECALL = 0.97
#: Cost of probing a bucket, in distances.
PROBE_COST = 64


@dataclass(frozen=True)
class Tables:
    dims: int
    rotations: int  # for each table
    tables: int = 8
    probes: int = 1  # buckets probed in each table
    recall: float = 1.0  # on the sample
    share: float = 1.0  # of the rows that are a query's candidates, estimated
    seed: int = 7

    @property
    def width(self) -> int:
        return max(2, 1 << (self.dims - 1).bit_length())

    def signs(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.choice(np.array([-1.0, 1.0], np.float32), (self.tables, self.rotations, 3, self.width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(math.sqrt(d))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray, width: int) -> np.ndarray:
    x = x / np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.pad(x.astype(np.float32), ((0, 0), (0, width - x.shape[1])))


def buckets(x: np.ndarray, t: Tables, probes: int = 1) -> np.ndarray:
    """Bucket numbers of each row: rows by tables by probes, best first."""
    x = unit(x, t.width)
    out = np.zeros((len(x), t.tables, probes), np.int64)
    axes = 2 * t.width
    for i, per_table in enumerate(t.signs()):
        score, code = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1), np.int64)
        for signs in per_table:
            y = rotate(x, signs)
            y = np.concatenate([y, -y], axis=1)
            keep = min(probes, axes)
            best = np.argsort(-y, axis=1, kind="stable")[:, :keep]
            value = np.take_along_axis(y, best, 1)
            total = (score[:, :, None] + value[:, None, :]).reshape(len(x), -1)
            codes = (code[:, :, None] * axes + best[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(-total, axis=1, kind="stable")[:, :probes]
            score, code = np.take_along_axis(total, pick, 1), np.take_along_axis(codes, pick, 1)
        out[:, i, : code.shape[1]] = code
        if code.shape[1] < probes:
            out[:, i, code.shape[1] :] = -1
    return out


def probe_ranks(queries: np.ndarray, rows: np.ndarray, t: Tables) -> np.ndarray:
    """How many buckets a query probes before it meets each row, in the table where it meets it first: queries by rows."""
    x, y = unit(queries, t.width), unit(rows, t.width)
    best = np.full((len(x), len(y)), np.iinfo(np.int64).max)
    for per_table in t.signs():
        of_query = [np.concatenate([r := rotate(x, s), -r], axis=1) for s in per_table]
        of_row = [np.concatenate([r := rotate(y, s), -r], axis=1).argmax(axis=1) for s in per_table]
        for i in range(len(x)):
            total, code = of_query[0][i], of_row[0]
            for q, c in zip(of_query[1:], of_row[1:], strict=True):
                total, code = (total[:, None] + q[i][None, :]).ravel(), code * len(q[i]) + c
            order = np.sort(-total)
            best[i] = np.minimum(best[i], np.searchsorted(order, -total[code], "left"))
    return best


def fit(queries: np.ndarray, near: list[np.ndarray], rows: np.ndarray, n: int, tables: int, recall: float = RECALL) -> Tables:
    """The cheapest index over ``n`` rows that finds the share ``recall`` of the sampled queries' true neighbours.

    ``near`` holds each query's neighbours, ``rows`` a sample of all rows.
    Probing every bucket finds all, so the share is always reached.
    """
    dims = queries.shape[1]
    found: list[tuple[float, Tables]] = []
    for rotations in (1, 2):
        t = Tables(dims, rotations, tables)
        ranks = np.sort(np.concatenate([probe_ranks(queries[i : i + 1], x, t)[0] for i, x in enumerate(near) if len(x)] or [np.zeros(1, np.int64)]))
        probes = int(ranks[min(len(ranks), math.ceil(recall * len(ranks))) - 1]) + 1
        share = float((probe_ranks(queries, rows, t) < probes).mean()) if len(rows) else 1.0
        t = Tables(dims, rotations, tables, probes, float((ranks < probes).mean()), share)
        found.append((n * share + PROBE_COST * tables * probes, t))
    return min(found, key=lambda x: x[0])[1]


def _bucket_column(t: Tables, probes: int):
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                got = buckets(x, t, probes)
                code = np.where(got < 0, -1, got * t.tables + np.arange(t.tables)[None, :, None])
                parts += code.reshape(len(part), -1).tolist()
            yield pa.array(parts, pa.list_(pa.int64()))

    return run.asNondeterministic()


def _nearest(k: int):
    """For one block of a bucket: each query's k nearest classes but its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["query"].to_numpy()
        q, c = pdf[side], pdf[~side]
        if not len(q) or not len(c):
            return pd.DataFrame({"query_class": [], "class": [], "score": []}).astype({"query_class": "int64", "class": "int64", "score": "float64"})
        a = np.stack(q["vector"].to_numpy()).astype(np.float64)
        b = np.stack(c["vector"].to_numpy()).astype(np.float64)
        qc, cc = q["class"].to_numpy(), c["class"].to_numpy()
        rows = []
        for i in range(len(a)):
            d = np.sqrt(((b - a[i]) ** 2).sum(axis=1))
            n = min(k + 1, len(d))
            far = np.partition(d, n - 1)[n - 1]
            near = np.flatnonzero(d <= far)
            near = near[cc[near] != qc[i]]
            near = near[np.lexsort((cc[near], d[near]))][:k]
            rows.append((np.full(len(near), qc[i]), cc[near], d[near]))
        return pd.DataFrame({"query_class": np.concatenate([r[0] for r in rows]), "class": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows])})

    return run


def _blocks(classes: DataFrame, entries: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query_class, class, score: each wanted class's k nearest of the classes in its buckets.

    A bucket's classes and the queries that probe it are cut into parts, every
    part of one meets every part of the other.
    """
    parts_c = entries.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cs"))
    parts_q = wanted.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs"))
    shape = parts_c.join(parts_q, "bucket")
    span = lambda x: F.sequence(F.lit(0), F.col(x) - 1)
    cut = lambda x: F.pmod(F.xxhash64("class"), F.col(x)).cast("int")
    side_c = entries.join(shape, "bucket").select("class", "bucket", cut("cs").alias("c"), F.explode(span("qs")).alias("q"), F.lit(False).alias("query"))
    side_q = wanted.join(shape, "bucket").select("class", "bucket", F.explode(span("cs")).alias("c"), cut("qs").alias("q"), F.lit(True).alias("query"))
    met = side_c.unionByName(side_q).join(classes.select("class", "vector"), "class")
    near = met.groupBy("bucket", "c", "q").applyInPandas(_nearest(k), "query_class bigint, class bigint, score double").distinct()
    best = F.row_number().over(Window.partitionBy("query_class").orderBy("score", "class"))
    return near.withColumn("place", best).where(F.col("place") <= k).drop("place")


def _scan(classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """As `_blocks`, with all classes: classes are dealt into slices of about a block, every query looks at each."""
    slices = max(1, math.ceil(classes.count() / BLOCK))
    entries = classes.select("class", F.pmod(F.xxhash64("class", F.lit(3)), F.lit(slices)).alias("bucket"))
    return _blocks(classes, entries, wanted.select("class", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))).alias("bucket")), k)


def fit_index(classes: DataFrame, wanted: DataFrame, k: int, tables: int, recall: float = RECALL) -> Tables:
    """Index for ``classes`` (class, vector), fitted on at most `SAMPLE` of the ``wanted`` classes, those with the smallest hashes, and on all rows."""
    picked = classes.join(wanted, "class", "left_semi").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("class", "vector").collect()
    sample = classes.sparkSession.createDataFrame([(r["class"],) for r in picked], "class bigint")
    pairs = _scan(classes, sample, k).select("query_class", "class")
    near = pairs.join(classes.select("class", "vector"), "class").collect()  # at most SAMPLE * k rows
    by: dict[int, list] = {r["class"]: [] for r in picked}
    for r in near:
        by[r["query_class"]].append(r["vector"])
    rows = classes.orderBy(F.xxhash64("class", F.lit(5)), "class").limit(ROWS).select("vector").collect()
    as_array = lambda x: np.array(x, np.float64)
    return fit(as_array([r["vector"] for r in picked]), [as_array(by[r["class"]]) for r in picked], as_array([r["vector"] for r in rows]), classes.count(), tables, recall)


def nearest(df: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, tables: int = 8, recall: float = RECALL, index: Tables | None = None) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id as ``id``, score (Euclidean distance in double precision).

    ``queries`` has a column ``id`` of rows of ``df``; a query is no neighbour
    of itself.  Every query gets k neighbours, or all other rows if these are
    fewer.  Ties go to the smaller id.  Vectors that are null, of another
    length than the most common one, zero, or that hold null or non-finite
    components take no part, nor do null ids; of rows that share an id the
    smallest vector counts.  Vectors of any length are rotated whole, padded to
    a power of two.  An empty table or query set gives no rows; other columns
    are ignored.  ``index`` is fitted to ``recall`` unless it is given.
    """
    spark = df.sparkSession
    ship(spark)
    v = F.col("v")
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], f"query_id bigint, rank int, {id} bigint, score double")
    if lengths is None:
        return empty
    rows = rows.where(F.size("v") == lengths["dims"]).groupBy("id").agg(F.min("v").alias("v"))
    # Equal vectors by class: the class is its smallest id, with the few ids that can be among the nearest.
    hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    firsts = hashed.withColumn("place", place).where(F.col("place") <= k + 1)
    classes = store(firsts.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("vector")), "classes")
    asked = rows.join(queries.select(F.col(id).alias("id")).distinct(), "id", "left_semi")
    asked = asked.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).join(classes.select("h1", "h2", "class"), ["h1", "h2"])
    asked = store(asked.select(F.col("id").alias("query_id"), "class"), "asked")
    if not asked.take(1):
        return empty

    t = index or fit_index(classes, asked.select("class").distinct(), k, tables, recall)
    entries = classes.select("class", F.explode(_bucket_column(t, 1)("vector")).alias("bucket"))
    wanted = classes.join(asked.select("class").distinct(), "class", "left_semi")
    wanted = wanted.select("class", F.explode(_bucket_column(t, t.probes)("vector")).alias("bucket")).where("bucket >= 0")
    near = _blocks(classes, store(entries, "entries"), store(wanted, "probes"), k)

    def ranked(near: DataFrame, asked: DataFrame) -> DataFrame:
        # A query's own class is nearest of all, at distance 0; each class stands for its smallest ids.
        own = asked.select(F.col("class").alias("query_class"), "class", F.lit(0.0).alias("score")).distinct()
        pairs = asked.withColumnRenamed("class", "query_class").join(near.unionByName(own), "query_class")
        members = pairs.join(classes.select("class", "ids"), "class").select("query_id", "score", F.explode("ids").alias("id")).where("id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return members.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")

    found = store(ranked(near, asked), "found")
    full = found.where(F.col("rank") == k).select("query_id")
    short = store(asked.join(full, "query_id", "left_anti"), "short")
    if not short.take(1):
        return found
    scanned = ranked(_scan(classes, short.select("class").distinct(), k), short)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(scanned)
