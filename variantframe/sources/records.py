"""Nested records: JSON scan, flattening, sanitation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from variantframe.functions.scalars import not_nan


def read_json(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema else r).json(path)


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Structs as dotted columns, lists of scalars as `; ` text, lists of structs and maps as JSON text."""
    out: list[Column] = []

    def add(c: Column, name: str, kind) -> None:
        if isinstance(kind, StructType):
            for f in kind.fields:
                add(c.getField(f.name), f"{name}{separator}{f.name}", f.dataType)
        elif isinstance(kind, ArrayType):
            nested = isinstance(kind.elementType, (StructType, ArrayType, MapType))
            out.append((F.when(c.isNotNull(), F.to_json(c)) if nested else F.array_join(c.cast("array<string>"), "; ")).alias(name))
        elif isinstance(kind, MapType):
            out.append(F.when(c.isNotNull(), F.to_json(c)).alias(name))
        else:
            out.append(c.alias(name))

    for f in df.schema.fields:
        add(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, so that rows can be written as JSON."""
    return df.select(*[not_nan(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def as_json(df: DataFrame, into: str = "json") -> DataFrame:
    safe = json_safe(df)
    return safe.select(F.to_json(F.struct(*[f"`{c}`" for c in safe.columns])).alias(into))
