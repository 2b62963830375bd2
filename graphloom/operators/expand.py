"""Expansion operators over compressed relations.

A row holds one id for every key vertex v (``k_v``) and an ascending id array for every set vertex
(``s_v``). Arrays never grow with a hub: a set is dealt over parts by its members' hashes, a row for each
part that is not empty (``q_v``), so keys and parts identify a row. Members lie in one part each, so counts
over rows add up. Candidate edges are tables (src, dst) and candidate adjacency
(src, part, nbrs). All joins are equi-joins on ids; distinctness is a residual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sets import has_representatives, without


def key(v: int) -> str:
    return f"k_{v}"


def held(v: int) -> str:
    return f"s_{v}"


def part(v: int) -> str:
    return f"q_{v}"


def keys_of(rel: DataFrame) -> list[str]:
    return [c for c in rel.columns if c.startswith("k_")]


def sets_of(rel: DataFrame) -> list[str]:
    return [c for c in rel.columns if c.startswith("s_")]


def identity(rel: DataFrame) -> list[str]:
    """The columns that tell rows apart: keys and parts."""
    return [c for c in rel.columns if c[:2] in ("k_", "q_")]


def part_of(member: str | Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(parts)).cast("int") if parts > 1 else F.lit(0)


def _differ(rel: DataFrame, name: str, same: list[int]) -> DataFrame:
    return reduce(lambda r, v: r.where(F.col(name) != F.col(key(v))), same, rel)


def adjacency(edges: DataFrame, parts: int = 1) -> DataFrame:
    """(src, part, nbrs) of candidate edges, the neighbours dealt over as many parts."""
    return edges.groupBy("src", part_of("dst", parts).alias("part")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def candidate_edges(edges: DataFrame, left: DataFrame | None, right: DataFrame | None) -> DataFrame:
    """The auxiliary index of a pattern edge: data edges between the candidates of its ends; None where any end will do."""
    if left is not None:
        edges = edges.join(left.select(F.col("id").alias("src")), "src", "left_semi")
    if right is not None:
        edges = edges.join(right.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges.select("src", "dst")


def root(cand: DataFrame, v: int) -> DataFrame:
    return cand.select(F.col("id").alias(key(v)))


def key_to_key(rel: DataFrame, p: int, t: int, edges: DataFrame, same: list[int] = ()) -> DataFrame:
    return _differ(rel.join(edges.toDF(key(p), key(t)), key(p)), key(t), list(same))


def keys_to_key(rel: DataFrame, parents: list[int], t: int, edges: dict[int, DataFrame], same: list[int] = ()) -> DataFrame:
    """One parent's edges give the rows, the others' confirm them on both ends."""
    out = key_to_key(rel, parents[0], t, edges[parents[0]], same)
    for p in parents[1:]:
        out = out.join(edges[p].toDF(key(p), key(t)), [key(p), key(t)], "left_semi")
    return out


def keys_to_set(rel: DataFrame, parents: list[int], t: int, adjacent: dict[int, DataFrame], same: list[int] = ()) -> DataFrame:
    """The parents' neighbours in common, without the keys of the same label; rows with none go."""
    out = rel
    for k, p in enumerate(parents):
        out = out.join(adjacent[p].toDF(key(p), part(t), "nbrs"), [key(p), part(t)] if k else key(p))
        out = out.withColumn(held(t), F.array_intersect(held(t), "nbrs") if k else F.col("nbrs")).drop("nbrs")
    return out.withColumn(held(t), without(F.col(held(t)), [F.col(key(v)) for v in same])).where(F.size(held(t)) > 0)


def key_to_set(rel: DataFrame, p: int, t: int, adjacent: DataFrame, same: list[int] = ()) -> DataFrame:
    return keys_to_set(rel, [p], t, {p: adjacent}, same)


def set_to_key_by_parent(rel: DataFrame, p: int, t: int, edges: DataFrame, same: list[int] = (), parts: int = 1) -> DataFrame:
    """Members of the set reach t; they are gathered again under each t."""
    told, others = [c for c in identity(rel) if c != part(p)], [s for s in sets_of(rel) if s != held(p)]
    met = _differ(rel.withColumn("x", F.explode(held(p))).drop(held(p), part(p)).join(edges.toDF("x", key(t)), "x"), key(t), list(same))
    return met.groupBy(*told, key(t), part_of("x", parts).alias(part(p))).agg(F.sort_array(F.collect_list("x")).alias(held(p)), *[F.first(s).alias(s) for s in others])


def sets_to_key(rel: DataFrame, parents: list[int], t: int, edges: DataFrame, back: dict[int, DataFrame], same: list[int] = ()) -> DataFrame:
    """The first parent's members propose t once each; every parent set shrinks to t's neighbours.

    ``edges`` lead from the first parent to t, ``back`` holds t's adjacency towards each parent.
    """
    met = rel.withColumn("x", F.explode(held(parents[0]))).join(edges.toDF("x", key(t)), "x").drop("x")
    return into(_differ(met.dropDuplicates([*identity(rel), key(t)]), key(t), list(same)), t, parents, back)


def set_to_key_by_extension(rel: DataFrame, p: int, t: int, edges: DataFrame, back: DataFrame, same: list[int] = ()) -> DataFrame:
    return sets_to_key(rel, [p], t, edges, {p: back}, same)


def set_to_key_by_candidate(rel: DataFrame, p: int, t: int, back: DataFrame, same: list[int] = ()) -> DataFrame:
    """From the candidates of t: those whose neighbours meet the set, with the part that meets it."""
    near = back.toDF(key(t), part(p), "nbrs").withColumn("x", F.explode("nbrs"))
    met = rel.withColumn("x", F.explode(held(p))).join(near, ["x", part(p)]).drop("x").dropDuplicates([*identity(rel), key(t)])
    return _differ(met.withColumn(held(p), F.array_intersect(held(p), "nbrs")).drop("nbrs"), key(t), list(same))


def into(rel: DataFrame, t: int, parents: list[int], back: dict[int, DataFrame]) -> DataFrame:
    """Close the edges between key t and set parents; rows with an empty set go."""
    for p in parents:
        near = back[p].toDF(key(t), part(p), "nbrs")
        rel = rel.join(near, [key(t), part(p)]).withColumn(held(p), F.array_intersect(held(p), "nbrs")).drop("nbrs").where(F.size(held(p)) > 0)
    return rel


def promote(rel: DataFrame, v: int, same: list[int] = ()) -> DataFrame:
    """A set becomes a key, a row for each member."""
    return _differ(rel.withColumn(key(v), F.explode(held(v))).drop(held(v), part(v)), key(v), list(same))


def prune_sets(rel: DataFrame, t: int, same_sets: list[int]) -> DataFrame:
    """Take a new key out of the sets of its label; rows with an empty set go."""
    for v in same_sets:
        rel = rel.withColumn(held(v), F.array_remove(held(v), F.col(key(t)))).where(F.size(held(v)) > 0)
    return rel


def set_pruning(rel: DataFrame, groups: list[list[int]]) -> DataFrame:
    """Rows whose same-label sets have different representatives, group by group."""
    for vs in groups:
        if len(vs) > 1:
            rel = rel.where(has_representatives([F.col(held(v)) for v in vs]))
    return rel
