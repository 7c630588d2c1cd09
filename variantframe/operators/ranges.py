"""Joins on ranges: overlap, nearest, interpolation, clusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked

#: Bin widths of overlap joins; an interval goes to the narrowest level at which it spans few bins.
LEVELS = (1 << 10, 1 << 14, 1 << 18, 1 << 22, 1 << 26, 1 << 31)
SPAN = 8


def range_join(points: DataFrame, intervals: DataFrame, chrom: str = "CHROM", pos: str = "pos", begin: str = "begin", end: str = "end") -> DataFrame:
    """Points with the intervals of their chromosome that contain them, begin included, end not.

    An equi-join on (chromosome, level, bin): each interval is cut into at most
    ten bins of one level by its length, each point has one bin in every level
    that is in use.  So long intervals do not multiply, no pair comes twice,
    and nothing is compared outside a bin.  Columns other than the chromosome
    must have different names.
    """
    size = F.col(end) - F.col(begin)
    level = None
    for i, w in enumerate(LEVELS):
        level = F.when(size <= SPAN * w, i) if level is None else level.when(size <= SPAN * w, i)
    level = level.otherwise(len(LEVELS) - 1)
    widths = F.array(*[F.lit(w).cast("long") for w in LEVELS])
    iv = intervals.where(F.col(begin) < F.col(end)).withColumn("_level", level).withColumn("_w", F.get(widths, F.col("_level")))
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(begin) / F.col("_w")), F.floor((F.col(end) - 1) / F.col("_w"))))).drop("_w")
    at = F.array(*[F.struct(F.lit(i).alias("_level"), F.floor(F.col(pos) / w).alias("_bin")) for i, w in enumerate(LEVELS)])
    pt = points.select("*", F.inline(at))
    hit = (F.col(pos) >= F.col(begin)) & (F.col(pos) < F.col(end))
    return pt.join(iv, [chrom, "_level", "_bin"]).where(hit).drop("_level", "_bin")


#: Points that one row of `overlaps` holds, and pairs that are made of it.
OVERLAP_POINTS = 1 << 14
OVERLAP_PAIRS = 1 << 17


def overlaps(points: DataFrame, intervals: DataFrame, key: str, id: str, chrom: str = "CHROM", pos: str = "pos", begin: str = "begin", end: str = "end", segment: int = 1 << 12) -> DataFrame:
    """The pairs of `range_join` by their ids alone: ``key`` of the point and ``id`` of the interval.

    Nothing is compared pair by pair.  Points are dealt out packed by segments
    and put in order there, so those in an interval's part are a stretch of
    them, found by two searches.  A row goes on with some points and the
    stretches in them, and pairs are made last, where the rows are used.
    Positions are whole numbers.
    """
    seg = lambda c: F.floor(c / F.lit(segment)).cast("long")
    at = points.where(F.col(chrom).isNotNull() & F.col(pos).isNotNull()).select(F.col(chrom).alias("_c"), seg(F.col(pos)).alias("_s"), (F.col(pos) - seg(F.col(pos)) * segment).cast("int").alias("_at"), F.col(key).alias("_k"))
    cut = intervals.where((F.col(begin) < F.col(end)) & F.col(chrom).isNotNull()).select(F.col(chrom).alias("_c"), F.col(begin).cast("long").alias("_b"), F.col(end).cast("long").alias("_e"), F.col(id).alias("_i"))
    cut = cut.select("*", F.explode(F.sequence(seg(F.col("_b")), seg(F.col("_e") - 1))).alias("_s"))
    low, high = F.greatest(F.col("_b") - F.col("_s") * segment, F.lit(0)), F.least(F.col("_e") - F.col("_s") * segment, F.lit(segment))
    cut = cut.select("_c", "_s", low.cast("int").alias("_lo"), high.cast("int").alias("_hi"), "_i", F.lit(None).cast("binary").alias("body"))
    none = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("_lo", "_hi", "_i")]
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows become many, so small parts are not put together
    laid = packed(at, ["_c", "_s"]).select("_c", "_s", *none, "body").unionByName(cut).repartition(tasks, "_c", "_s").sortWithinPartitions("_c", "_s", F.col("body").isNull(), "_lo")
    of = {c: df.schema[c].dataType.simpleString() for df, c in ((at, "_k"), (cut, "_i"))}
    schema = f"points array<{of['_k']}>, parts array<struct<i:{of['_i']},first:int,n:int>>"
    most_points, most_pairs = OVERLAP_POINTS, OVERLAP_PAIRS

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, places, keys = None, [], None, None

        def row(some: pa.Array, ids: pa.Array, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            parts = pa.StructArray.from_arrays([ids, pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["i", "first", "n"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([one(some), one(parts)], names=["points", "parts"])

        for batch in batches:
            chroms, segs, packs = batch.column(0), batch.column(1).to_numpy(), batch.column(5)
            code = chroms.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((segs[1:] != segs[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(segs)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                new = (chroms[x].as_py(), int(segs[x]))
                if new != now:
                    now, places = new, None
                    held.clear()
                part = batch.slice(x, y - x)
                points_here = len(part) - part.column(5).null_count
                held += [unpacked(packs[i].as_buffer()) for i in range(x, x + points_here)]
                if points_here == len(part) or not held and places is None:
                    continue
                if held:
                    table = pa.concat_tables(held)
                    held.clear()
                    places = table.column(0).to_numpy()
                    order = np.argsort(places, kind="stable")
                    places, keys = places[order], table.column(1).take(pa.array(order)).combine_chunks()
                rest = part.slice(points_here)
                a, b = (np.searchsorted(places, rest.column(c).to_numpy()) for c in (2, 3))
                for p in range(0, len(places), most_points):
                    lo, hi = np.clip(a - p, 0, most_points), np.clip(b - p, 0, most_points)
                    use = np.flatnonzero(lo < hi)
                    if len(use) == 0:
                        continue
                    lo, hi = lo[use], hi[use]
                    sums = np.cumsum(hi - lo) // most_pairs
                    cuts = [0, *(np.flatnonzero(sums[1:] != sums[:-1]) + 1).tolist(), len(use)]
                    for u, v in zip(cuts[:-1], cuts[1:], strict=True):
                        least = int(lo[u:v].min())
                        yield row(keys.slice(p + least, int(hi[u:v].max()) - least), rest.column(4).take(pa.array(use[u:v])), lo[u:v] - least + 1, hi[u:v] - lo[u:v])

    parts = laid.mapInArrow(lay, schema).select("points", F.explode("parts").alias("part"))
    return parts.select(F.explode(F.slice("points", F.col("part.first"), F.col("part.n"))).alias(key), F.col("part.i").alias(id))


#: Positions of a segment in which `best_covering` lays intervals over each other, and cells of one table of it.
COVER_SEGMENT = 1 << 12
COVER_CELLS = 1 << 22
#: Rows of a segment after which those that others cover are forgotten.
COVER_ROWS = 1 << 17


def best_covering(points: DataFrame, intervals: DataFrame, order: Sequence[Column], best: Sequence[str], lists: Sequence[str] = (), group: str | None = None, chrom: str = "CHROM", pos: str = "pos", begin: str = "begin", end: str = "end", segment: int = COVER_SEGMENT, key: str | None = None) -> DataFrame:
    """For each distinct position of the points the first interval in ``order`` that contains it: chromosome, position, columns ``best``, n and ``lists``.

    With ``group`` the first interval of each group counts; ``n`` is their
    number, the first of them all gives ``best``, and each text column of
    ``lists`` becomes a comma list of their texts in order, empty ones left out.
    Positions in no interval have no row; ``order`` must tell apart all
    intervals that differ in the columns asked for.  With ``key`` the rows are
    those of the points, with that column instead of chromosome and position;
    points are then dealt out packed and not joined with their places again.

    No pair of a point and an interval becomes a row.  Intervals are cut at the
    ends of segments, and one sort puts a segment's positions before its
    intervals, the last in order first.  Each interval is then laid over its
    positions in a table with a line for each group, so what lies on top at the
    end is the first.  Positions are whole numbers, groups are not null.
    """
    spark_types = dict((f.name, f.dataType) for f in intervals.schema.fields)
    seg = lambda c: F.floor(c / F.lit(segment)).cast("long")
    g = F.col(group).cast("string") if group else F.lit("")
    cut = intervals.where((F.col(begin) < F.col(end)) & F.col(chrom).isNotNull())
    facts = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate([*best, *lists])])
    cut = cut.select(F.col(chrom).alias("_c"), g.alias("_g"), F.col(begin).cast("long").alias("_b"), F.col(end).cast("long").alias("_e"), facts.alias("_f"))
    cut = cut.select("*", F.explode(F.sequence(seg(F.col("_b")), seg(F.col("_e") - 1))).alias("_s"))
    low, high = F.greatest(F.col("_b") - F.col("_s") * segment, F.lit(0)), F.least(F.col("_e") - F.col("_s") * segment, F.lit(segment))
    cut = cut.select("_c", "_s", low.cast("int").alias("_lo"), high.cast("int").alias("_hi"), "_g", "_f")
    at = points.where(F.col(chrom).isNotNull() & F.col(pos).isNotNull()).select(F.col(chrom).alias("_c"), F.col(pos).cast("long").alias("_p"), *([F.col(key).alias("_k")] if key else []))
    at = (at if key else at.distinct()).select("_c", seg(F.col("_p")).alias("_s"), (F.col("_p") - seg(F.col("_p")) * segment).cast("int").alias("_lo"), *(["_k"] if key else []))
    at = packed(at, ["_c", "_s"]).select("_c", "_s", F.lit(None).cast("int").alias("_lo"), "body") if key else at.withColumn("body", F.lit(None).cast("binary"))
    at = at.select("_c", "_s", "_lo", F.lit(None).cast("int").alias("_hi"), F.lit(None).cast("string").alias("_g"), F.lit(None).cast(cut.schema["_f"].dataType).alias("_f"), "body")
    laid = at.unionByName(cut.withColumn("body", F.lit(None).cast("binary"))).repartition("_c", "_s").sortWithinPartitions("_c", "_s", F.col("_hi").isNotNull(), F.desc("_f"), "_lo", "_hi")
    nb, values = len(best), [f"_v{i}" for i in range(len(best) + len(lists))]
    laid = laid.select("_c", "_s", "_lo", "_hi", "_g", *[F.col(f"_f.{v}").alias(v) for v in values], "body")
    types = [laid.schema["_c"].dataType, *[spark_types[c] for c in best]]
    place = [f"_k {points.schema[key].dataType.simpleString()}"] if key else ["_c " + types[0].simpleString(), "_p bigint"]
    schema = ", ".join([*place, *[f"`{c}` {t.simpleString()}" for c, t in zip(best, types[1:], strict=True)], "n int", *[f"`{c}` string" for c in lists]])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, where, those, spans, kept, size = None, [], [], [], [], 0
        names = [*(["_k"] if key else ["_c", "_p"]), *best, "n", *lists]

        def layers() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Positions, a block at a time, with the row on top in each line there, or -1."""
            places = np.unique(np.concatenate(where))
            lo, hi, line = (np.concatenate(x) for x in zip(*spans, strict=True))
            line = pa.array(line, pa.string()).dictionary_encode().indices.to_numpy()
            lo, hi, lines = np.searchsorted(places, lo), np.searchsorted(places, hi), int(line.max()) + 1
            step = max(1, COVER_CELLS // lines)
            for first in range(0, len(places), step):
                here = places[first : first + step]
                top = np.full((lines, len(here)), -1, np.int64)
                a, b = np.clip(lo - first, 0, len(here)), np.clip(hi - first, 0, len(here))
                use = np.flatnonzero(a < b)
                for k, r, x, y in zip(use.tolist(), line[use].tolist(), a[use].tolist(), b[use].tolist(), strict=True):
                    top[r, x:y] = k  # later rows come first in order
                yield here, top

        def prune() -> None:
            """Forget rows that others cover wholly."""
            seen = np.unique(np.concatenate([np.unique(top) for _, top in layers()])) if where else np.zeros(0, np.int64)
            seen = seen[seen >= 0]
            spans[:] = [tuple(np.concatenate(x)[seen] for x in zip(*spans, strict=True))]
            kept[:] = pa.Table.from_batches(kept).take(pa.array(seen)).combine_chunks().to_batches()

        def emit() -> Iterator[pa.RecordBatch]:
            if not where or not kept:
                return
            table = pa.Table.from_batches(kept).combine_chunks()
            points_at = np.concatenate(where)
            points_keys = pa.chunked_array(those) if key else None
            texts = [table.column(1 + nb + i).to_numpy() for i in range(len(lists))]
            for here, top in layers():
                top = -np.sort(-top.T, axis=1)
                n = (top >= 0).sum(axis=1)
                hit = np.flatnonzero(n)
                if len(hit) == 0:
                    continue
                joined = [[",".join(filter(None, t[top[p, : n[p]]].tolist())) for p in hit] for t in texts]
                chosen = table.take(pa.array(top[hit, 0]))
                found = [chosen.column(0), pa.array(here[hit] + now[1] * segment, pa.int64())]
                columns = [*found, *[chosen.column(1 + i) for i in range(nb)], pa.array(n[hit], pa.int32()), *[pa.array(j, pa.string()) for j in joined]]
                if key:
                    at_hit = np.minimum(np.searchsorted(here[hit], points_at), len(hit) - 1)
                    mine = np.flatnonzero(here[hit][at_hit] == points_at)
                    columns = [points_keys.take(pa.array(mine)), *pa.table(columns[2:], names=names[1:]).take(pa.array(at_hit[mine])).columns]
                yield from pa.table(columns, names=names).combine_chunks().to_batches(max_chunksize=2048)

        for batch in batches:
            chroms, segs = batch.column(0), batch.column(1).to_numpy()
            code = chroms.dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero((segs[1:] != segs[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(segs)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                new = (chroms[x].as_py(), int(segs[x]))
                if new != now:
                    yield from emit()
                    now, size = new, 0
                    where.clear(), those.clear(), spans.clear(), kept.clear()
                part = batch.slice(x, y - x)
                points_here = part.column(3).null_count
                if key:
                    for i in range(points_here):
                        table = unpacked(part.column(part.num_columns - 1)[i].as_buffer())
                        where.append(table.column(0).to_numpy())
                        those.extend(table.column(1).chunks)
                elif points_here:
                    where.append(part.column(2).slice(0, points_here).to_numpy())
                if points_here < y - x:
                    rest = part.slice(points_here)
                    spans.append((rest.column(2).to_numpy(), rest.column(3).to_numpy(), rest.column(4).to_numpy(zero_copy_only=False)))
                    kept.append(pa.RecordBatch.from_arrays([rest.column(0), *[rest.column(5 + i) for i in range(nb + len(lists))]], names=["c", *[f"v{i}" for i in range(nb + len(lists))]]))
                    size += len(rest)
                    if size > COVER_ROWS:
                        prune()
                        size = 0  # so many more before the next time
        yield from emit()

    return laid.mapInArrow(lay, schema).withColumnsRenamed({"_k": key} if key else {"_c": chrom, "_p": pos})


def nearest_interval(points: DataFrame, intervals: DataFrame, id: str, chrom: str = "CHROM", pos: str = "pos", begin: str = "begin", end: str = "end", key: str = "point_id", limit: int | None = None, segment: int = 1 << 22) -> DataFrame:
    """Nearest interval of each point: its id and distance, 0 inside; ties go to the one on the left, then the smallest id.

    Points and interval ends are laid in one order of position.  A window from
    the left carries the greatest end so far (it tells inside as well), one
    from the right the least begin.  Chromosomes are cut into segments, and
    what a segment hands on to the next is carried over a table with one row
    for each segment, so no task holds a whole chromosome.  Points without
    intervals on their chromosome, or beyond ``limit``, have nulls.
    """
    seg = lambda c: F.floor(c / segment)
    p = points.select(F.col(chrom).alias("c"), F.col(pos).alias("x"), F.col(key).alias("k"))
    a = intervals.select(F.col(chrom).alias("c"), F.col(begin).alias("b"), F.col(end).alias("e"), F.col(id).alias("i"))
    # From the left: an interval enters at its begin and offers its end.
    reach = a.select("c", F.col("b").alias("x"), F.lit(None).cast(p.schema["k"].dataType).alias("k"), F.struct(F.col("e"), F.col("i")).alias("l"), F.lit(0).alias("o"))
    left = reach.unionByName(p.withColumn("l", F.lit(None).cast(reach.schema["l"].dataType)).withColumn("o", F.lit(1)))
    left = left.withColumn("s", seg(F.col("x")))
    best = lambda c: F.max(c)
    carry = left.where("l is not null").groupBy("c", "s").agg(best("l").alias("top"))
    w = Window.partitionBy("c").orderBy("s")
    segments = left.select("c", "s").distinct().join(carry, ["c", "s"], "left")
    handed = segments.withColumn("from_left", best("top").over(w.rowsBetween(Window.unboundedPreceding, -1))).select("c", "s", "from_left")
    run = Window.partitionBy("c", "s").orderBy("x", "o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = left.withColumn("own", best("l").over(run)).where("k is not null").join(handed, ["c", "s"], "left")
    left = left.select("k", "c", "x", F.greatest("own", "from_left").alias("l"))
    # From the right: the next begin after the point.
    starts = a.select("c", F.col("b").alias("x"), F.lit(None).cast(p.schema["k"].dataType).alias("k"), F.struct(F.col("b"), F.col("i")).alias("r"), F.lit(1).alias("o"))
    right = starts.unionByName(p.withColumn("r", F.lit(None).cast(starts.schema["r"].dataType)).withColumn("o", F.lit(0))).withColumn("s", seg(F.col("x")))
    first = right.where("r is not null").groupBy("c", "s").agg(F.min("r").alias("top"))
    segments = right.select("c", "s").distinct().join(first, ["c", "s"], "left")
    handed = segments.withColumn("from_right", F.min("top").over(w.rowsBetween(1, Window.unboundedFollowing))).select("c", "s", "from_right")
    back = Window.partitionBy("c", "s").orderBy(F.desc("x"), F.desc("o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = right.withColumn("own", F.min("r").over(back)).where("k is not null").join(handed, ["c", "s"], "left")
    right = right.select("k", F.least("own", "from_right").alias("r"))
    both = left.join(right, "k")
    dl = F.greatest(F.col("x") - F.col("l.e") + 1, F.lit(0))
    dr = F.col("r.b") - F.col("x")
    use_left = F.col("l").isNotNull() & (F.col("r").isNull() | (dl <= dr))
    d = F.when(use_left, dl).otherwise(dr)
    near = both.select(F.col("k").alias(key), F.when(use_left, F.col("l.i")).otherwise(F.col("r.i")).alias(id), d.alias("distance"))
    if limit is not None:
        ok = F.col("distance") <= limit
        near = near.select(key, F.when(ok, F.col(id)).alias(id), F.when(ok, F.col("distance")).alias("distance"))
    return near


#: Width of the segments that whole chromosomes are cut into, in positions.
SEGMENT = 1 << 20


def gap_clusters(df: DataFrame, by: Sequence[str], pos: str, gap: int, cluster: str = "cluster", segment: int = SEGMENT) -> DataFrame:
    """Adds the number of the cluster (from 1, by position) in which each row's position lies within ``gap`` of the one before.

    Windows run over segments; what a segment needs to know of those before it,
    the last position and the number of clusters, comes from a table with one
    row a segment.
    """
    cut = df.withColumn("_seg", F.floor(F.col(pos) / segment))
    w = Window.partitionBy(*by, "_seg").orderBy(pos)
    order = Window.partitionBy(*[f"_g_{c}" for c in by]).orderBy("_s")
    keys = [F.col(c).alias(f"_g_{c}") for c in by]
    edges = cut.groupBy(*keys, F.col("_seg").alias("_s")).agg(F.max(pos).alias("_last")).withColumn("_prior", F.lag("_last").over(order)).drop("_last")

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, [a[c].eqNullSafe(b[f"_g_{c}"]) for c in by] + [a["_seg"].eqNullSafe(b["_s"])]).drop("_s", *[f"_g_{c}" for c in by])

    first = beside(cut, edges)
    new = F.when(F.col(pos) - F.coalesce(F.lag(pos).over(w), F.col("_prior")) <= gap, 0).otherwise(1)
    marked = first.withColumn("_new", new).withColumn("_own", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = marked.groupBy(*keys, F.col("_seg").alias("_s")).agg(F.sum("_new").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return beside(marked, counts).withColumn(cluster, F.col("_before") + F.col("_own")).select(*[F.col(f"`{c}`") for c in df.columns if c != cluster], cluster)


def interpolate(points: DataFrame, grid: DataFrame, by: Sequence[str], pos: str = "pos", x: str = "x", y: str = "y", key: str = "point_id", segment: int = SEGMENT) -> DataFrame:
    """Value at each point on the line between the grid's neighbours, the end values beyond the grid.

    Grid and points are laid in one order within segments; the last grid row
    before and the first after each point come from windows, or, beyond the
    segment's own, from a table with one row a segment.
    """
    g = grid.groupBy(*by, F.col(x).alias("p")).agg(F.min(y).alias("v")).withColumn("k", F.lit(None).cast(points.schema[key].dataType))
    p = points.select(*by, F.col(pos).alias("p"), F.lit(None).cast("double").alias("v"), F.col(key).alias("k"))
    rows = g.select(*by, "p", F.col("v").cast("double").alias("v"), "k").unionByName(p).withColumn("at", F.when(F.col("k").isNull(), F.struct("p", "v")))
    rows = rows.withColumn("_seg", F.floor(F.col("p") / segment))
    ends = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_seg").alias("_s")).agg(F.min("at").alias("_lo"), F.max("at").alias("_hi"))
    # Both ways run from an end of the order up to the row: a frame that ends behind all rows is added up anew for each.
    order = Window.partitionBy(*[f"_g_{c}" for c in by]).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*[f"_g_{c}" for c in by]).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_left", F.last("_hi", ignorenulls=True).over(order)).withColumn("_right", F.last("_lo", ignorenulls=True).over(back))
    rows = rows.join(ends, [rows[c].eqNullSafe(ends[f"_g_{c}"]) for c in by] + [rows["_seg"].eqNullSafe(ends["_s"])])
    w = Window.partitionBy(*by, "_seg").orderBy("p", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = Window.partitionBy(*by, "_seg").orderBy(F.desc("p"), F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_before", F.last("at", ignorenulls=True).over(w)).withColumn("_after", F.last("at", ignorenulls=True).over(v))
    rows = rows.withColumn("a", F.coalesce("_before", "_left")).withColumn("b", F.coalesce("_after", "_right")).where("k is not null")
    share = (F.col("p") - F.col("a.p")) / F.nullif(F.col("b.p") - F.col("a.p"), F.lit(0))
    value = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("a.p") == F.col("p")), F.col("a.v")).otherwise(F.col("a.v") + share * (F.col("b.v") - F.col("a.v")))
    return rows.select(F.col("k").alias(key), value.alias(y))
