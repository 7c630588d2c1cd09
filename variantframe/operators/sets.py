"""Set operations on tables and ids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def overlap(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Numbers of distinct non-null ids in both, only the first, only the second and in either."""
    x = a.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.lit(1).alias("s"))
    y = b.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.lit(2).alias("s"))
    kinds = x.unionByName(y).groupBy("id").agg(F.bit_or("s").alias("s"))
    return kinds.agg(F.count_if(F.col("s") == 3).alias("both"), F.count_if(F.col("s") == 1).alias("only_first"), F.count_if(F.col("s") == 2).alias("only_second"), F.count("*").alias("either"))


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def restrict(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose keys occur in ``b``."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in both."""
    return a.intersect(b)


def pairs_per_row(df: DataFrame, left: str, right: str) -> DataFrame:
    """Every combination of two array columns' elements, by row; an empty or null array gives none."""
    a = F.transform(F.col(left), lambda x: F.transform(F.col(right), lambda y: F.struct(x.alias(f"{left}_item"), y.alias(f"{right}_item"))))
    return df.select("*", F.inline(F.flatten(a)))
