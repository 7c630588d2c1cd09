"""Near-duplicate documents by circulant MinHash, with exact verification.

Two permutations of a universe are drawn.  The first moves the shingles about,
the second is shifted circularly by 0, 1, 2 ... for the signature's
coordinates, so a shingle's values for all coordinates are one slice of a
table.  Rows of coordinates are banded; documents meet in buckets.  Links are
confirmed on full shingle sets:

1. Documents with equal sets form one class; only classes go on.
2. In each bucket the pivot, the member with the most companions, is compared
   with every member on full sets.  This costs one pair for each member and
   joins most of a large group.
3. What a bucket still holds in different components meets in blocks of bounded
   size: pairs that the signature leaves possible are compared on full sets,
   and the block gives the links of a spanning forest of its components, so no
   more rows than it has members.  Nothing is capped: a link between different
   sets is lost only if the bands or the signature miss it (each about 1 in a
   million at the threshold).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ship, store
from .components import connected_components
from .shingles import mix, shingle_sets

#: Size of the permuted universe (a power of two).
UNIVERSE = 1 << 22
#: Coordinates of a band.
ROWS = 5
#: Probability of missing a pair at the threshold.
MISS = 1e-6
#: Members of one part of a large bucket, and shingles that a part's sets hold; a block has one or two parts.
BLOCK, SHINGLES = 2048, 3_000_000
#: Standard deviations that a signature's estimate may lie below the threshold.
SLACK = 5.0
#: Texts whose sets are held at a time.
TEXTS = 500


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


@lru_cache(maxsize=4)
def _permutations(coordinates: int) -> tuple[int, int, np.ndarray]:
    """The first permutation (odd factor and shift) and the second one's slices, one for each place of the universe."""
    rng = np.random.default_rng(20_240_229)
    factor, shift = int(rng.integers(UNIVERSE)) | 1, int(rng.integers(UNIVERSE))
    table = rng.permutation(UNIVERSE).astype(np.int32)
    table = np.concatenate([table, table[:coordinates]])
    return factor, shift, np.lib.stride_tricks.sliding_window_view(table, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    factor, shift, slices = _permutations(coordinates)
    at = (((shingles >> np.uint64(20)).astype(np.int64) & (UNIVERSE - 1)) * factor + shift) & (UNIVERSE - 1)
    sig = slices[at[:2048]].min(axis=0)
    for i in range(2048, len(at), 2048):
        sig = np.minimum(sig, slices[at[i : i + 2048]].min(axis=0))
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(-1, ROWS).astype(np.uint64)
    h = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return h.view(np.int64)


SKETCH = pa.struct([("n", pa.int64()), ("key", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(df: DataFrame, text: str, k: int, bands: int, into: str) -> DataFrame:
    """Add struct ``into``: set size, the set's key, low bytes of the signature, band hashes (the last three null for an empty set)."""

    @F.arrow_udf("struct<n: bigint, key: binary, sig: binary, bands: array<bigint>>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for i in range(0, len(batch), TEXTS):
                for s in shingle_sets(batch.slice(i, TEXTS), k):
                    if len(s):
                        sig = signature(s, bands * ROWS)
                        out.append((len(s), hashlib.blake2b(s, digest_size=16).digest(), sig.astype(np.uint8).tobytes(), band_hashes(sig)))
                    else:
                        out.append((0, None, None, None))
            cols = [pa.array([x[j] for x in out], SKETCH.field(j).type) for j in range(4)]
            yield pa.StructArray.from_arrays(cols, fields=list(SKETCH))

    return df.withColumn(into, sketch.asNondeterministic()(F.col(text)))


class _Sets:
    """Full shingle sets of a block's texts, as codes of the block's own universe."""

    def __init__(self, texts: pd.Series, k: int):
        sets = shingle_sets(pa.array(texts.tolist(), pa.string()), k)
        self.sizes = np.array([len(s) for s in sets])
        begins = np.cumsum([0, *self.sizes])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.codes = [codes[p:q] for p, q in zip(begins[:-1], begins[1:], strict=True)]
        self.mark = np.zeros(len(values), bool)

    def linked(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others have 100 * intersection >= percent * union with i."""
        near = others[(self.sizes[others] * 100 >= percent * self.sizes[i]) & (self.sizes[i] * 100 >= percent * self.sizes[others])]
        if not len(near):
            return near
        self.mark[self.codes[i]] = True
        begins = np.cumsum([0, *self.sizes[near[:-1]]])
        both = np.add.reduceat(self.mark[np.concatenate([self.codes[j] for j in near])], begins, dtype=np.int64)
        self.mark[self.codes[i]] = False
        return near[100 * both >= percent * (self.sizes[near] + self.sizes[i] - both)]


def _star_links(k: int, percent: int):
    """For one part of a pivot's members: links between the pivot and them."""

    def star(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, hub = pdf["key"].tolist(), int(np.flatnonzero(pdf["hub"].to_numpy())[0])
        others = np.flatnonzero(~pdf["hub"].to_numpy())
        ok = _Sets(pdf["text"], k).linked(hub, others, percent)
        return pd.DataFrame({"a": [keys[hub]] * len(ok), "b": [keys[j] for j in ok]}, dtype=object)

    return star


def _block_forest(coordinates: int, k: int, percent: int):
    """For one block of a bucket: links that join its members' components, as pairs of components, fewer than it has members."""
    t = percent / 100
    least = coordinates * (t - SLACK * math.sqrt(t * (1 - t) / coordinates))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        comp = pdf["comp"].tolist()
        label = pd.factorize(pdf["comp"])[0]
        own, apart = pdf["own"].to_numpy(), pdf["i"][0] != pdf["j"][0]
        band = int(pdf["band"][0])
        rows: list[tuple[bytes, bytes]] = []
        if (label != label[0]).any() and not (apart and (own == own[0]).all()):
            sets = _Sets(pdf["text"], k)
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
            bands = np.stack(pdf["bands"].to_numpy())
            for i in range(len(pdf) - 1):
                rest = np.arange(i + 1, len(pdf))
                at = rest[label[rest] != label[i]]
                if apart:  # pairs within one part of a large bucket are another task's
                    at = at[own[at] != own[i]]
                if len(at):  # a pair that meets in several bands is compared once, in the first
                    at = at[(bands[at] == bands[i]).argmax(axis=1) == band]
                at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
                for j in sets.linked(i, at, percent).tolist():
                    if label[j] != label[i]:
                        rows.append((comp[i], comp[j]))
                        label[label == label[j]] = label[i]
        return pd.DataFrame(rows, columns=["a", "b"], dtype=object)

    return forest


def _parts(members: Column, shingles: Column) -> Column:
    """Into how many parts so many members with so many shingles are cut."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``df``: ``id``, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of distinct k-word shingles (A-Z lower-cased; with fewer words the whole
    sequence is the only shingle).  component_id is the smallest id reachable by
    links, kept is whether that is the row's own id.

    Null, empty and wordless texts have an empty set and are linked with
    nothing.  Rows with a null id take no part: component_id is null and they
    are kept.  Repeated rows are one document and come out as often as they went
    in; rows that share an id but not a text are linked by their texts alone.
    Texts of any length count whole; ties go to the smaller id; an empty table
    gives an empty result; other columns are ignored.
    """
    ship(df.sparkSession)
    bands = band_count(percent / 100)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    base = store(sketches(rows, "text", k, bands, "s").select("id", "s.*"), "sketches")
    alive = base.where("key is not null and id is not null")
    classes = alive.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    entries = classes.select("key", F.posexplode("bands").alias("band", "h"))
    buckets = entries.groupBy("band", "h").agg(F.count("*").alias("members")).where("members > 1")
    met = store(entries.join(buckets, ["band", "h"]), "met")

    # The facts and texts of classes that meet another, each class once.
    hubs = met.groupBy("key").agg(F.sum("members").alias("weight"))
    nodes = hubs.join(classes, "key")
    found = rows.join(nodes.select("key", F.col("rep").alias("id")), "id")
    if df.select(id).groupBy(id).count().where("count > 1").take(1):  # a shared id: keep the text that the key stands for
        again = sketches(found, "text", k, bands, "s")
        found = again.where("s.key = key").select("key", "text").dropDuplicates(["key"])
    texts = store(nodes.drop("rep").join(found.select("key", "text"), "key"), "texts")

    # Each bucket's pivot: the member with the most companions, which a group's buckets mostly share.
    pivots = met.join(hubs, "key").groupBy("band", "h").agg(F.max(F.struct("weight", "key"))["key"].alias("pivot"))
    met = store(met.join(pivots, ["band", "h"]), "pivots")
    pairs = met.where("key <> pivot").select("pivot", "key").distinct()
    sized = store(pairs.join(texts.select("key", "n"), "key"), "pairs")
    shape = sized.groupBy("pivot").agg(_parts(F.count("*"), F.sum("n")).alias("parts"))
    member = sized.join(shape, "pivot").select("pivot", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), "key", F.lit(False).alias("hub"))
    centre = shape.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("key"), F.lit(True).alias("hub"))
    filled = member.select("pivot", "part").distinct()
    stars = member.unionByName(centre.join(filled, ["pivot", "part"], "left_semi").select(member.columns)).join(texts.select("key", "text"), "key")
    stars = store(stars.groupBy("pivot", "part").applyInPandas(_star_links(k, percent), "a binary, b binary"), "stars")
    roots = connected_components(stars)

    # Buckets whose members, but for the pivot that was compared with all, are still in different components.
    within = met.where("members > 2 and key <> pivot").select("band", "h", "key")
    within = within.join(roots.withColumnRenamed("node", "key"), "key", "left").select("band", "h", "key", F.coalesce("root", "key").alias("comp"))
    within = store(within.join(texts.select("key", "n"), "key"), "within")
    open_ = within.groupBy("band", "h").agg(
        F.min("comp").alias("lo"),
        F.max("comp").alias("hi"),
        F.count("*").alias("m"),
        F.sum("n").alias("n"),
        F.sum(F.xxhash64("key") % 1_000_003).alias("s1"),
        F.sum(F.xxhash64("key", F.lit(1)) % 1_000_003).alias("s2"),
    )
    open_ = open_.where("lo <> hi").groupBy("m", "n", "s1", "s2", "lo", "hi").agg(F.min(F.struct("band", "h")).alias("first"))  # buckets of the same members once
    open_ = open_.select("first.band", "first.h", _parts(F.col("m"), F.col("n")).alias("parts"))
    todo = within.select("band", "h", "key", "comp").join(open_, ["band", "h"])
    todo = todo.withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    todo = todo.select("band", "h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "comp")
    todo = todo.join(texts.select("key", "sig", "bands", "text"), "key")
    links = store(todo.groupBy("band", "h", "i", "j").applyInPandas(_block_forest(bands * ROWS, k, percent), "a binary, b binary"), "links")
    joined = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))

    ends = roots.join(joined, "root", "left").select(F.col("node").alias("key"), F.coalesce("top", "root").alias("root"))
    lone = joined.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("key"), F.col("top").alias("root"))
    reach = classes.select("key", "rep").join(ends.unionByName(lone), "key")
    lowest = reach.groupBy("root").agg(F.min("rep").alias("low"))
    component = store(reach.join(lowest, "root").select("key", F.col("low").alias("component_id")), "components")
    reps = alive.groupBy("key").agg(F.min("id").alias("rep"))
    component = reps.join(component, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    out = base.select("id", "n", "key").join(component, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    own = F.when(F.col("id").isNotNull(), own)
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("id").isNull() | (own == F.col("id"))).alias("kept"))


def drop_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``df`` with one document left of each group, see `near_duplicates`; rows with a null id stay.

    Of repeated rows of a kept document one stays.
    """
    mark = fresh(df, "kept_id")
    kept = near_duplicates(df, id, text, k, percent).where("kept").where(F.col(id).isNotNull()).select(F.col(id).alias(mark)).distinct()
    named = df.where(F.col(id).isNotNull()).dropDuplicates([id])
    return named.join(kept, named[id] == kept[mark]).drop(mark).unionByName(df.where(F.col(id).isNull()))
