"""Filters that prune candidate sets against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sets import has_representatives
from graphloom.graph import LabeledGraph
from graphloom.plans.pattern import Pattern


def neighbourhood(graph: LabeledGraph, p: Pattern, cand: dict[int, DataFrame], v: int, pivots: list[int]) -> DataFrame:
    """Candidates of v with a neighbour among the candidates of every pivot: one semi-join each."""
    out = cand[v]
    for w in pivots:
        near = graph.edges.where((F.col("src_label") == p.labels[v]) & (F.col("dst_label") == p.labels[w])).select("src", F.col("dst").alias("id")).join(cand[w], "id", "left_semi").select(F.col("src").alias("id"))
        out = out.join(near, "id", "left_semi")
    return out


def matching(graph: LabeledGraph, p: Pattern, cand: dict[int, DataFrame], v: int) -> DataFrame:
    """Candidates of v whose neighbours can stand for all pattern neighbours at once, all different.

    Label by label, as choices of different labels cannot collide. A pattern neighbour with as many choices as
    there are neighbours of the label never fails, so only shorter lists of choices are collected.
    """
    out = cand[v]
    by_label: dict[int, list[int]] = {}
    for w in p.adj[v]:
        by_label.setdefault(p.labels[w], []).append(w)
    for label, group in by_label.items():
        edges = graph.edges.where((F.col("src_label") == p.labels[v]) & (F.col("dst_label") == label)).select(F.col("src").alias("v"), F.col("dst").alias("id")).join(out.toDF("v"), "v", "left_semi")
        members = reduce(DataFrame.union, [cand[w].select("id", F.lit(w).alias("w")) for w in group])
        choices = edges.join(members, "id").select(F.col("v").alias("id"), "w", F.col("id").alias("x"))
        counts = choices.groupBy("id").agg(*[F.count(F.when(F.col("w") == w, 1)).alias(f"n{w}") for w in group])
        counts = counts.where(reduce(lambda a, b: a & b, [F.col(f"n{w}") > 0 for w in group]))
        n = len(group)
        if n > 1:
            few = counts.where(reduce(lambda a, b: a | b, [F.col(f"n{w}") < n for w in group]))
            short = reduce(lambda a, b: a | b, [(F.col("w") == w) & (F.col(f"n{w}") < n) for w in group])
            lists = choices.join(few, "id").where(short).groupBy("id").agg(*[F.sort_array(F.collect_list(F.when(F.col("w") == w, F.col("x")))).alias(f"a{w}") for w in group])
            # a list that was too long to be collected is empty here: n members that none else has stand for it
            own = [F.when(F.size(f"a{w}") > 0, F.col(f"a{w}")).otherwise(F.array(*[F.lit(-1 - n * k - j).cast("bigint") for j in range(n)])) for k, w in enumerate(group)]
            bad = lists.where(~has_representatives(own)).select("id")
            counts = counts.select("id").join(bad, "id", "left_anti")
        out = out.join(counts.select("id"), "id", "left_semi")
    return out
