"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed by source, targets follow from the weights, and the rate at
which a source's documents repeat is target / size.  Each document is emitted
floor(rate) times, and once more if a draw seeded by its id falls below the
rest of the rate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh

#: A source's words are repeated at most so often.
MOST = 3


def rotating_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... for ranks from 1."""
    return (rank - 1) % 3 + 1


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    blank_ends = (F.get(parts, F.lit(0)) == "").cast("int") + ((F.get(parts, F.size(parts) - 1) == "") & (F.size(parts) > 1)).cast("int")
    return (F.size(parts) - blank_ends).cast("long")


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = rotating_weights, most: int = MOST) -> DataFrame:
    """Targets of sources: ``sizes`` has source and source_size; adds weight and target.

    Sources rank by code point, null last.  Targets share the sum of sizes by
    weight; none exceeds ``most`` times its source's size, the excess is shared
    by weight among the others until none is above.  That ends where all
    sources below their limit get the same amount for each unit of weight, so
    sources are taken in the order of limit / weight: from the first on whose
    share of what is left fits, all fit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("weight", weight(rank).cast("double")).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.withColumn("total", F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    filled = filled.withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    filled = filled.withColumn("share", F.col("left") / F.sum("weight").over(after))
    fits = F.col("share") * F.col("weight") < F.col("limit")
    level = F.first(F.when(fits, F.col("share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.coalesce(F.least(level * F.col("weight"), F.col("limit").cast("double")), F.col("limit").cast("double"))
    return filled.withColumn("level", level).withColumn("target", target).select("source", "source_size", "weight", "target")


def mixture(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", into: str = "mix", seed: str = "", weight: Callable[[Column], Column] = rotating_weights, most: int = MOST) -> DataFrame:
    """Add struct ``into``: size, source_size, target, rate and copies.

    Size is the number of words.  Null and empty texts have size 0 and, their
    rate being their source's, are repeated like others.  Null is a source of
    its own; rows with a null id draw like rows whose id is an empty text.
    Repeated rows share their draw.  A source without words has rate 0.  Very
    long texts count whole; an empty table stays empty; other columns are kept
    and ``into`` gets underscores if the name is taken.  The same rows give the
    same copies in every run.
    """
    into = fresh(df, into)
    size, key = fresh(df, "size_"), fresh(df, "source_")
    sized = df.withColumn(size, word_count(F.col(text)))
    # Null-safe key: a mark before every source that is not null.
    sized = sized.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    sums = sized.groupBy(key).agg(F.first(source).alias("source"), F.sum(size).alias("source_size"))
    targets = source_targets(sums, weight, most).withColumn(key, F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    targets = targets.select(F.col(key), F.struct("source_size", "target").alias(fresh(df, "t_")))
    t = targets.columns[1]
    joined = sized.join(targets, key)
    rate = F.when(F.col(f"{t}.source_size") > 0, F.col(f"{t}.target") / F.col(f"{t}.source_size")).otherwise(F.lit(0.0))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    whole = F.floor(rate)
    copies = whole + (draw < rate - whole).cast("long")
    made = F.struct(F.col(size).alias("size"), F.col(f"{t}.source_size"), F.col(f"{t}.target"), rate.alias("rate"), copies.alias("copies"))
    return joined.withColumn(into, made).select(*[F.col(f"`{c}`") for c in df.columns], into)


def emit(df: DataFrame, into: str = "mix") -> DataFrame:
    """Each row of `mixture`'s result as often as its copies say, without the struct."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    n = F.col(f"{into}.copies").cast("int")
    one = fresh(df, "copy_")
    return df.where(n > 0).select(*kept, F.explode(F.sequence(F.lit(1), n)).alias(one)).drop(one)
