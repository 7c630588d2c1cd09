"""Catalog tables: upsert, time to live, append-only log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantframe.operators.common import first_per


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), latest: Column | None = None) -> DataFrame:
    """Old rows with the new rows' values laid over them, and new keys added.

    Null values of a new row keep the old ones; columns in ``keep`` keep the
    old value where there is one.  Of new rows with one key the one with the
    greatest ``latest`` counts (else the smallest row).
    """
    rest = [c for c in old.columns if c not in keys]
    order = [latest.desc()] if latest is not None else []
    one = first_per(new, keys, [*order, *[F.col(c) for c in rest]])
    n = one.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in rest], F.lit(True).alias("n_there"))
    on = [old[k] == n[f"n_{k}"] for k in keys]
    j = old.join(n, on, "full")
    value = lambda c: F.coalesce(c, f"n_{c}") if c in keep else F.coalesce(f"n_{c}", c)
    return j.select(*[F.coalesce(k, f"n_{k}").alias(k) for k in keys], *[value(c).alias(c) for c in rest])


def alive(df: DataFrame, updated: str, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """Rows not older than their time to live, to the microsecond."""
    moment = now if now is not None else F.current_timestamp()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return df.where(micros(moment) - micros(F.col(updated)) < F.lit(ttl_seconds).cast("long") * 1_000_000)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
