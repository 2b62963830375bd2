"""Connected components of an edge table by repeated contraction, fully distributed.

In a round every vertex points to its neighbour (or itself) of the smallest hash; edges are
redrawn between the vertices pointed to, loops and repeats go. Hash order keeps the pointer chains
short whatever the ids, so the edges are gone after a number of rounds logarithmic in a component's
size. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id): for each id in an edge, the smallest id reachable. Null ends and loops are ignored."""
    live = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = settle(live.select(F.col("a").alias("id")).union(live.select("b")).distinct().select("id", F.col("id").alias("root")), "labels")
    order = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("id"))
    while not live.isEmpty():
        both = live.select(F.col("a").alias("v"), F.col("b").alias("u")).union(live.select("b", "a"))
        to = settle(both.groupBy("v").agg(F.min(order("u")).alias("m")).select("v", F.least(F.struct(F.xxhash64("v"), F.col("v").alias("id")), F.col("m"))["id"].alias("to")), "parents")
        pa, pb = to.toDF("a", "pa"), to.toDF("b", "pb")
        drawn = live.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        new_live = settle(drawn, "edges")
        new_labels = settle(labels.join(to.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "labels")
        for old in (live, labels, to):
            discard(old)
        live, labels = new_live, new_labels
    least = labels.groupBy("root").agg(F.min("id").alias("component_id"))
    out = settle(labels.join(least, "root").select("id", "component_id"), "components")
    discard(live)
    discard(labels)
    return out
