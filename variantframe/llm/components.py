"""Connected components of a link table by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the same for all nodes of a component) for every node that has a link.

    Each round leads every node to the smallest of itself and its neighbours,
    follows these leads to their ends by doubling, and contracts the links
    accordingly.  At least half of the nodes vanish in a round, so rounds and
    doublings both grow with a logarithm.  Every step is stored, which cuts the
    lineage.  Null ends, self-links and repeated links
    are ignored; an empty table has no nodes.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = store(ends.distinct(), "links")
    roots: DataFrame | None = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        led = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("at"), F.least("a", "to").alias("to"))
        led = store(led, "led")
        while True:
            ahead = led.select(F.col("at").alias("mid"), F.col("to").alias("end"))
            jumped = store(led.join(ahead, led["to"] == ahead["mid"]).select("at", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "led")
            led = jumped.select("at", "to")
            if not jumped.where("moved").take(1):
                break
        if roots is None:
            roots = led.select(F.col("at").alias("node"), F.col("to").alias("root"))
        else:
            moved = roots.join(led, roots["root"] == led["at"], "left")
            roots = store(moved.select("node", F.coalesce("to", "root").alias("root")), "roots")
        half = edges.join(led, edges["a"] == led["at"]).select(F.col("to").alias("a"), "b")
        full = half.join(led, half["b"] == led["at"]).select("a", F.col("to").alias("b"))
        edges = store(full.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if roots is None:
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
