"""Registration of queries with their oracles, and rounding for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import oracle, role

Roles = Callable[[str], DataFrame]


class Book:
    """Collects queries; each gets a function of its roles and SQL for DuckDB."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None, roles: str = "") -> Callable:
        def wrap(f: Callable[[Roles], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: f(lambda r: role(spark, sf_dir, r))
            if sql:
                self.oracles[name] = oracle(sql, roles)
            return f

        return wrap


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Floating-point columns rounded, as sums may differ in their last digits by the order of the rows."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
