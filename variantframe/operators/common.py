"""Shared plan helpers: broadcasts by checked size, deterministic picks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Estimated bytes up to which a side is broadcast.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if the optimizer's estimate of its size is within ``limit``, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def first_per(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order, which must end in a unique key.

    Catalyst limits the groups before the shuffle, so a large group costs n
    rows for each task only.  ``rank`` keeps the position under that name.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where that is unset and Spark runs in one process (tests) a local one
    is made; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="variantframe_")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def store_round(df: DataFrame) -> DataFrame:
    """One round's table of an iterative operator, with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def packed(df: DataFrame, keys: Sequence[str], every: int = 1 << 18) -> DataFrame:
    """Rows of equal keys among ``every`` that a task meets together as one row: the keys, and their other columns as compressed Arrow data.

    A column of neighbours takes a fraction of what single rows take in a shuffle.
    """
    n = len(keys)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.sort_by([(k, "ascending") for k in table.column_names[:n]])
        codes = [table.column(i).combine_chunks().dictionary_encode().indices.to_numpy() for i in range(n)]
        edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist(), len(table)]
        rest = table.select(list(range(n, table.num_columns)))
        bodies = []
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema) as out:
                out.write_table(rest.slice(x, y - x))
            body = sink.getvalue()
            bodies.append(len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True))
        yield pa.RecordBatch.from_arrays([*[table.column(i).take(pa.array(edges[:-1])).combine_chunks() for i in range(n)], pa.array(bodies, pa.binary())], names=[*table.column_names[:n], "body"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += len(b)
            if size >= every:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("body", T.BinaryType())])
    return df.select(*keys, *[c for c in df.columns if c not in keys]).mapInArrow(pack, schema)


def unpacked(body: pa.Buffer) -> pa.Table:
    """The columns of a row of `packed`."""
    return pa.ipc.open_stream(pa.decompress(body.slice(8), int.from_bytes(body.slice(0, 8).to_pybytes(), "little"), "zstd")).read_all()


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, into: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row in one order over the whole table.

    The order must end in a unique key.  A table within ``limit`` estimated
    bytes is one window.  A larger one is dealt out by ranges of the order and
    checkpointed; each range is summed up by itself and the ranges before it
    are added from a table with one row for each range.
    """
    if estimated_bytes(df) <= limit:
        return df.withColumn(into, F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    dealt = store_round(df.withColumn("_rs_value", value).repartitionByRange(*order).withColumn("_rs_part", F.spark_partition_id()))
    parts = dealt.groupBy("_rs_part").agg(F.sum("_rs_value").alias("_rs_sum"))
    before = F.coalesce(F.sum("_rs_sum").over(Window.orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_rs_part", before.alias("_rs_before"))
    own = F.sum("_rs_value").over(Window.partitionBy("_rs_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dealt.withColumn("_rs_own", own).join(F.broadcast(parts), "_rs_part")  # one row for each range
    return out.withColumn(into, F.col("_rs_own") + F.col("_rs_before")).drop("_rs_value", "_rs_part", "_rs_own", "_rs_before")


def exact_quantiles(df: DataFrame, value: Column | str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a whole column, interpolated between neighbours as ``percentile`` does; None without any value.

    Distinct values are counted and summed up by `running_sum`, so no task
    holds them all, as one task's map of values would.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = df.select(v.alias("_v")).where("_v is not null").groupBy("_v").agg(F.count("*").alias("_n"))
    runs = running_sum(counts, [F.col("_v")], F.col("_n"), "_to")
    total = F.broadcast(counts.agg(F.sum("_n").alias("_all")))  # one row
    runs = runs.join(total)
    cells = []
    for q in shares:
        at = F.lit(float(q)) * (F.col("_all") - 1)
        cells += [F.min(F.when(F.col("_to") > F.floor(at), F.col("_v"))), F.min(F.when(F.col("_to") > F.ceil(at), F.col("_v"))), F.max(at - F.floor(at))]
    got = runs.agg(*cells).first()
    return [None if lo is None else lo + (hi - lo) * part if part else lo for lo, hi, part in zip(got[0::3], got[1::3], got[2::3], strict=True)]
