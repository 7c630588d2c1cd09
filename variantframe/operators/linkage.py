"""Record linkage by tolerance scores: by id, by blocked characteristics, arbitration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_per, packed, unpacked

Tier = tuple[int, int]  # greatest difference, points


def tier_points(diff: Column, tiers: Sequence[Tier], beyond: tuple[int, int] | None = None) -> Column:
    """Points of the first tier that the difference fits in; ``beyond`` (above, points) applies past the tiers; a null difference has 0."""
    out = None
    for most, points in tiers:
        out = F.when(diff <= most, points) if out is None else out.when(diff <= most, points)
    if beyond:
        out = out.when(diff > beyond[0], beyond[1])
    return F.coalesce(out, F.lit(0))


def linear_points(diff: Column, weight: float, tolerance: float) -> Column:
    """weight * (1 - difference / tolerance) within the tolerance, else 0."""
    return F.coalesce(F.when(diff <= tolerance, weight * (1 - diff / tolerance)), F.lit(0.0))


#: Points by difference.
ID_BASE, ID_MEASURE, ID_AGE = 100, [(0, 30), (1, 20), (2, 10)], [(0, 20), (1, 10), (2, 5)]
TRAIT_BASE, TRAIT_DATE, TRAIT_AGE, TRAIT_MEASURE, TRAIT_BIRTH = 10, [(0, 30), (2, 20), (5, 10)], [(0, 30), (1, 20), (2, 10)], [(0, 25), (1, 15), (2, 8)], [(0, 20), (1, 10)]
CERTAIN = 150


def criteria(parts: dict[str, Column]) -> Column:
    """Comma list of the names whose condition holds."""
    return F.array_join(F.filter(F.array(*[F.when(c, n) for n, c in parts.items()]), lambda x: x.isNotNull()), ",")


def criteria_bits(parts: dict[str, Column]) -> Column:
    """The names whose condition holds as bits: what travels in a shuffle instead of their list."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(parts.values())]
    return sum(bits[1:], bits[0]).cast("byte")


def criteria_of(bits: str, names: Sequence[str]) -> Column:
    """`criteria` of `criteria_bits`."""
    return criteria({n: F.col(bits).bitwiseAND(F.lit(1 << i).cast("byte")) != 0 for i, n in enumerate(names)})


def link_by_id(left: DataFrame, right: DataFrame, days: int = 5) -> DataFrame:
    """Best partner with the same id, dates at most ``days`` apart: left_id, right_id, score, criteria.

    ``left`` and ``right`` have row ids (left_id, right_id), link_id, day,
    height, weight, age; ties go to the smaller right_id.
    """
    r = right.select("right_id", "link_id", *[F.col(c).alias(f"r_{c}") for c in ("day", "height", "weight", "age")])
    j = left.where("link_id is not null and link_id <> ''").join(r, "link_id")
    gap = F.abs(F.datediff("r_day", "day"))
    j = j.where(gap.isNull() | (gap <= days))
    dh, dw, da = (F.abs(F.col(f"r_{c}") - F.col(c)) for c in ("height", "weight", "age"))
    date = F.coalesce(F.when(gap == 0, 50).when(gap <= days, 30 - 5 * gap), F.lit(0))
    score = F.lit(ID_BASE) + date + tier_points(dh, ID_MEASURE, (2, -20)) + tier_points(dw, ID_MEASURE, (2, -20)) + tier_points(da, ID_AGE)
    why = {"ID": F.lit(True), "DATE": gap <= days, "HEIGHT": dh <= 2, "WEIGHT": dw <= 2, "AGE": da <= 2}
    best = first_per(j.select("left_id", "right_id", score.cast("int").alias("score"), criteria_bits(why).alias("criteria")), ["left_id"], [F.desc("score"), F.col("right_id")])
    return best.select("left_id", "right_id", "score", criteria_of("criteria", list(why)).alias("criteria"))


#: Days of left rows that one group of `link_by_traits` holds, right rows that it adds up at once, and those that it gathers before equal ones are dropped.
BLOCK_DAYS = 16
COLUMNS = 1 << 14
GATHERED = 1 << 18
#: Rows that are dealt out at a time by `_packed`, and rows of a group's left side put in order at once.
PACKED = 1 << 18


def _packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`packed` by `PACKED` rows."""
    return packed(df, keys, PACKED)


def _unpacked(batches: Iterator[pa.RecordBatch], n: int, most: int, side: int, order: str) -> Iterator[pa.RecordBatch]:
    """Rows of `_packed` in batches, the ``n`` keys first; where the key at ``side`` is 1, up to ``most`` rows or a few more in ``order``."""
    held: list[pa.Table] = []
    size, now = 0, None

    def ordered() -> Iterator[pa.RecordBatch]:
        if held:
            yield from pa.concat_tables(held).sort_by(order).combine_chunks().to_batches(max_chunksize=1 << 14)
        held.clear()

    for b in batches:
        for i in range(len(b)):
            key = tuple(b.column(k)[i].as_py() for k in range(n))
            if key != now or size > most:
                yield from ordered()
                now, size = key, 0
            table = unpacked(b.column(n)[i].as_buffer())
            keys = [pa.repeat(b.column(k)[i], len(table)) for k in range(n)]
            table = pa.table([*keys, *table.columns], names=[*b.schema.names[:n], *table.column_names])
            if not key[side]:
                yield from table.combine_chunks().to_batches()
            else:
                held.append(table)
                size += len(table)
    yield from ordered()


def link_by_traits(left: DataFrame, right: DataFrame, days: int = 5, years: int = 3) -> DataFrame:
    """Best partner of equal sex with a date 0 to ``days`` later and an age at most ``years`` off.

    Both sides are dealt out by sex and blocks of days, right rows also to the
    blocks before that reach their day, packed by `_packed`.  Within a block a left row's score with
    all its candidates is the sum of four lines of small numbers, each made
    once for a value of a trait, so no pair becomes a row.  Of right rows that
    are equal in all traits only the smallest id is kept, as others can't win.
    Points, and the criteria of the pairs chosen, are those of `tier_points`.
    Traits are compared as doubles.
    """
    traits, names = ("age", "height", "weight", "birth_year"), ("day", "age", "height", "weight", "birth_year")
    block = lambda c: F.floor(c / F.lit(BLOCK_DAYS)).cast("long")
    at = F.unix_date("day").cast("long")
    known = "day is not null and sex is not null"
    r = right.where(known).select("right_id", "sex", at.alias("_d"), *[F.col(c).alias(f"r_{c}") for c in names])
    r = r.select("*", F.explode(F.sequence(block(F.col("_d") - days), block(F.col("_d")))).alias("_b"))
    l = left.where(known).select("left_id", "sex", at.alias("_d"), *names, block(at).alias("_b"))
    none = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    rc = ["right_id", *[f"r_{c}" for c in names]]
    key = ["sex", "_b", "_d"]
    finite = lambda c, other: F.when(F.isnan(c), F.lit(other)).otherwise(c)  # NaN is far from all
    numbers = [F.coalesce(finite(F.col(f"r_{c}").cast("double"), float("-inf")), finite(F.col(c).cast("double"), float("inf"))).alias(f"_{c}") for c in traits]
    both = r.select(*key, *none(l, ["left_id", *names]), *rc, F.lit(0).alias("_left")).unionByName(l.select(*key, "left_id", *names, *none(r, rc), F.lit(1).alias("_left")))
    both = both.select("sex", "_b", "_left", "_d", *numbers, "left_id", *names, *rc)
    dealt = _packed(both, ["sex", "_b", "_left"]).repartition("sex", "_b").sortWithinPartitions("sex", "_b", "_left")
    schema = T.StructType([l.schema["left_id"], *[l.schema[c] for c in names], *[T.StructField(c, r.schema[c].dataType) for c in rc]])
    points = [(TRAIT_AGE, None), (TRAIT_MEASURE, (3, -10)), (TRAIT_MEASURE, (3, -10)), (TRAIT_BIRTH, (2, -15))]
    most_in_order = PACKED
    nl, out_of_reach = 1 + len(names), -(1 << 13)

    def line(v: float, seen: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
        """Points of one left value with each right row, by the values seen there; NaN stands for null."""
        d = np.abs(seen - v)
        there = ~np.isnan(d)
        p = np.zeros(len(seen), np.int16)
        if points[k][1]:
            p[there & (d > points[k][1][0])] = points[k][1][1]
        for most, n in reversed(points[k][0]):
            p[there & (d <= most)] = n
        if k == 0:
            p[there & (d > years)] = out_of_reach
        return p[codes]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, gathered = None, None, []

        def compact() -> tuple[np.ndarray, pa.Table]:
            """Right rows of the group so far in order of id: numbers (day and traits), and columns handed on."""
            parts = [*([rows] if rows else []), *gathered]
            table, handed = np.concatenate([p[0] for p in parts]), pa.concat_tables([p[1] for p in parts])
            gathered.clear()
            by_id = pc.sort_indices(handed.column(0), null_placement="at_start")
            table, handed = table[by_id.to_numpy()], handed.take(by_id)
            if len(table) > GATHERED:
                order = np.lexsort(table.T)  # stable: of equal rows the smallest id comes first
                new = np.concatenate([[True], (table[order[1:]] != table[order[:-1]]).any(axis=1)])
                first = np.sort(order[new])
                table, handed = table[first], handed.take(pa.array(first))
            return table, handed.combine_chunks()

        day, spans = None, []

        def open_day(d: int) -> None:
            """The candidates of a left day, a span of columns at a time, with no line made yet."""
            nonlocal day
            day = d
            spans.clear()
            table = rows[0]
            near = np.flatnonzero((table[:, 0] >= d) & (table[:, 0] <= d + days))
            for x in range(0, len(near), COLUMNS):
                some = near[x : x + COLUMNS]
                gap = table[some, 0] - d
                p = np.zeros(len(some), np.int16)
                for most, n in reversed(TRAIT_DATE):
                    p[gap <= most] = n
                spans.append((some, p, [np.unique(table[some, 1 + k], return_inverse=True, equal_nan=True) for k in range(4)], [{} for _ in range(4)], np.empty(len(some), np.int16)))

        def best(values: tuple) -> tuple[int, int]:
            top, at = 0, -1
            for some, gap, seen, made, sum_ in spans:
                four = []
                for k, v in enumerate(values):
                    got = made[k].get(v)
                    if got is None:
                        if len(made[k]) > 256:  # memory of lines, not results, ends here
                            made[k].clear()
                        got = line(np.nan if v is None else v, *seen[k], k)
                        if k == 0:
                            got = got + gap
                        made[k][v] = got
                    four.append(got)
                np.add(four[0], four[1], out=sum_)
                np.add(sum_, four[2], out=sum_)
                np.add(sum_, four[3], out=sum_)
                i = int(sum_.argmax())  # the first of equal ones: the smallest id
                if sum_[i] + TRAIT_BASE > top:
                    top, at = int(sum_[i]) + TRAIT_BASE, int(some[i])
            return top, at

        for b in _unpacked(batches, 3, most_in_order, 2, "_d"):
            sexes, blocks, lefts = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            code = sexes.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (code[1:] != code[:-1]) | (lefts[1:] != lefts[:-1])) + 1).tolist(), len(blocks)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                new = (sexes[x].as_py(), int(blocks[x]))
                if new != now:
                    now, rows, day = new, None, None
                    gathered.clear()
                part = b.slice(x, y - x)
                if not lefts[x]:
                    numbers = np.column_stack([part.column(3).to_numpy().astype(np.float64), *[part.column(4 + k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(4)]])
                    gathered.append((numbers, pa.Table.from_batches([part.select(list(range(8 + nl, part.num_columns)))])))
                    if sum(len(g[0]) for g in gathered) > max(GATHERED, len(rows[0]) if rows else 0):
                        rows = compact()
                    continue
                if gathered:
                    rows, day = compact(), None
                if rows is None:
                    continue
                picks, chosen = [], []
                for i, (d, *values) in enumerate(zip(part.column(3).to_pylist(), *[part.column(4 + k).to_pylist() for k in range(4)], strict=True)):
                    if d != day:
                        open_day(d)
                    at_row = best(tuple(values))[1]
                    if at_row >= 0:
                        picks.append(i)
                        chosen.append(at_row)
                if picks:
                    mine = part.take(pa.array(picks, pa.int32()))
                    theirs = rows[1].take(pa.array(chosen, pa.int64())).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*[mine.column(8 + k) for k in range(nl)], *[theirs.column(k).combine_chunks() for k in range(theirs.num_columns)]], names=schema.names)

    j = dealt.mapInArrow(link, schema)
    gap = F.datediff("r_day", "day")
    dh, dw, da, db = (F.abs(F.col(f"r_{c}") - F.col(c)) for c in ("height", "weight", "age", "birth_year"))
    score = F.lit(TRAIT_BASE) + tier_points(gap, TRAIT_DATE) + tier_points(da, TRAIT_AGE) + tier_points(dh, TRAIT_MEASURE, (3, -10)) + tier_points(dw, TRAIT_MEASURE, (3, -10)) + tier_points(db, TRAIT_BIRTH, (2, -15))
    why = {"SEX": F.lit(True), "DATE": gap <= days, "AGE": da <= 2, "HEIGHT": dh <= 2, "WEIGHT": dw <= 2, "BIRTH_YEAR": db <= 1}
    best = first_per(j.select("left_id", "right_id", score.cast("int").alias("score"), criteria_bits(why).alias("criteria")), ["left_id"], [F.desc("score"), F.col("right_id")])
    return best.select("left_id", "right_id", "score", criteria_of("criteria", list(why)).alias("criteria"))


def arbitrate(left: DataFrame, by_id: DataFrame, by_traits: DataFrame) -> DataFrame:
    """One link for each left row: an id link of at least 150 points, else the better one, the id link on ties; with method and confidence."""
    a = by_id.select("left_id", F.struct("right_id", "score", "criteria").alias("a"))
    b = by_traits.select("left_id", F.struct("right_id", "score", "criteria").alias("b"))
    j = left.select("left_id").join(a, "left_id", "left").join(b, "left_id", "left")
    use_a = F.col("a").isNotNull() & ((F.col("a.score") >= CERTAIN) | F.col("b").isNull() | (F.col("a.score") >= F.col("b.score")))
    pick = F.when(use_a, F.col("a")).otherwise(F.col("b"))
    method = F.when(use_a, "ID").when(F.col("b").isNotNull(), "TRAITS").otherwise("NONE")
    out = j.select("left_id", pick["right_id"].alias("right_id"), F.coalesce(pick["score"], F.lit(0)).alias("score"), pick["criteria"].alias("criteria"), method.alias("method"))
    return out.withColumn("confidence", confidence(F.col("score"), F.col("criteria"), F.col("method")))


def confidence(score: Column, criteria: Column, method: Column) -> Column:
    """Tier of a link; measured links (height and weight) have tiers of their own."""
    measured = criteria.contains("HEIGHT") & criteria.contains("WEIGHT")
    by_id = F.when(score >= 200, "EXACT_ID").when(score >= 150, "VERY_HIGH_ID").otherwise("HIGH_ID")
    full = F.when(score >= 100, "EXACT").when(score >= 80, "VERY_HIGH").when(score >= 60, "HIGH").otherwise("MEDIUM")
    bare = F.when(score >= 70, "HIGH_UNMEASURED").when(score >= 50, "MEDIUM_UNMEASURED").otherwise("LOW_UNMEASURED")
    return F.when(method == "NONE", "NONE").when(method == "ID", by_id).when(measured, full).otherwise(bare)


def link_blocked(left: DataFrame, right: DataFrame, block: Sequence[str], score: Column, least: float) -> DataFrame:
    """All pairs within a block whose score reaches a threshold, best partner of each left row first; columns must not clash."""
    j = left.join(right, list(block)).withColumn("score", score).where(F.col("score") >= least)
    return first_per(j.select("left_id", "right_id", "score"), ["left_id"], [F.desc("score"), F.col("right_id")])


def link_near(left: DataFrame, right: DataFrame, value_left: str, value_right: str, within: float, score: Column, least: float) -> DataFrame:
    """Best partner of each left row among all pairs whose values differ by ``within`` at most and whose score reaches a threshold; columns must not clash.

    Every pair that a score which ends at that difference can find is compared,
    with no other block: values fall into bins of that width and meet their own
    and the two neighbouring bins.  Null values have no partner.
    """
    bin_of = lambda c: F.floor(F.col(c) / within)
    l = left.where(F.col(value_left).isNotNull()).withColumn("_bin", F.explode(F.array(*[bin_of(value_left) + k for k in (-1, 0, 1)])))
    r = right.where(F.col(value_right).isNotNull()).withColumn("_bin", bin_of(value_right))
    j = l.join(r, "_bin").where(F.abs(F.col(value_left) - F.col(value_right)) <= within).withColumn("score", score).where(F.col("score") >= least)
    return first_per(j.select("left_id", "right_id", "score"), ["left_id"], [F.desc("score"), F.col("right_id")])


def attach_session(trials: DataFrame, sessions: DataFrame, key: Sequence[str], tie: str) -> DataFrame:
    """Trials with the session of their composite key; of repeated keys the first by ``tie`` counts."""
    return trials.join(first_per(sessions, key, [F.col(tie)]), list(key), "left")
