"""What is made of matches: counts and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sets import MOST_SETS, distinct_tuples, size
from graphloom.operators.expand import held, key, keys_of, promote, prune_sets, sets_of
from graphloom.plans.pattern import Pattern


def _kinds(rel: DataFrame, p: Pattern) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Key and set vertices by label."""
    keys: dict[int, list[int]] = {}
    sets: dict[int, list[int]] = {}
    for c in rel.columns:
        if c[:2] in ("k_", "s_"):
            v = int(c[2:])
            (keys if c[0] == "k" else sets).setdefault(p.labels[v], []).append(v)
    return keys, sets


def limit_sets(rel: DataFrame, p: Pattern, most: int = MOST_SETS) -> DataFrame:
    """Turn sets into keys until no label has more sets than the closed form takes."""
    keys, sets = _kinds(rel, p)
    for label, own in sets.items():
        same = list(keys.get(label, []))
        while len(own) > most:
            v = own.pop()
            rel = prune_sets(promote(rel, v, same), v, own)
            same.append(v)
    return rel


def per_row(rel: DataFrame, p: Pattern):
    """Embeddings in a row: labels are independent; within one, tuples of different members. Sets hold no key of their label."""
    _, sets = _kinds(rel, p)
    parts = [distinct_tuples([F.col(held(v)) for v in own]) for own in sets.values()]
    return reduce(lambda a, b: a * b, parts, F.lit(1).cast("bigint"))


def product(rel: DataFrame):
    """Combinations of a row's members, equal ones among them: never less than its embeddings."""
    return reduce(lambda a, b: a * b, [size(F.col(s)) for s in sets_of(rel)], F.lit(1).cast("bigint"))


def existing(rel: DataFrame, p: Pattern) -> DataFrame:
    """The rows with an embedding."""
    rel = limit_sets(rel, p)
    return rel.where(per_row(rel, p) > 0)


def described(rel: DataFrame) -> DataFrame:
    """One text ``value`` a row: keys and members by pattern vertex."""
    names = sorted([*keys_of(rel), *sets_of(rel)], key=lambda c: int(c[2:]))
    shown = [F.concat(F.lit(f"{c[2:]}:"), F.col(c).cast("string") if c[0] == "k" else F.concat(F.lit("{"), F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))), F.lit("}"))) for c in names]
    return rel.select(F.concat_ws(" ", *shown).alias("value"))


def count(rel: DataFrame, p: Pattern, limit: int | None = None, weights: dict[int, DataFrame] | None = None, pairs: dict[tuple[int, int], DataFrame] | None = None) -> DataFrame:
    """One row ``n``: embeddings, clipped to the limit.

    ``weights`` (id, w) by key vertex and ``pairs`` (src, dst, w) by two of them multiply a row's embeddings. With a limit no
    more rows that have an embedding are taken than it says.
    """
    rel = limit_sets(rel, p)
    n = per_row(rel, p)
    for v, w in (weights or {}).items():
        rel = rel.join(w.toDF(key(v), f"w_{v}"), key(v))
        n = n * F.col(f"w_{v}")
    for (a, b), w in (pairs or {}).items():
        rel = rel.join(w.toDF(key(a), key(b), f"w_{a}_{b}"), [key(a), key(b)])
        n = n * F.col(f"w_{a}_{b}")
    found = rel.select(n.alias("n"))
    if limit:
        found = found.where("n > 0").limit(limit)
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return found.agg((F.least(n, F.lit(limit).cast("bigint")) if limit else n).alias("n"))


def rows(rel: DataFrame, p: Pattern, order: list[int], limit: int | None = None) -> DataFrame:
    """One row per embedding: u0, u1, ... by pattern vertex, columns in matching order."""
    keys, _ = _kinds(rel, p)
    for c in sets_of(rel):
        v = int(c[2:])
        same = keys.setdefault(p.labels[v], [])
        rel = promote(rel, v, same)
        same.append(v)
    out = rel.select(*[F.col(key(v)).alias(f"u{v}") for v in order])
    return out.limit(limit) if limit else out
