"""Set expressions over ascending id arrays."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Same-label sets counted by the closed form; more are turned into keys first.
MOST_SETS = 5
#: Sets whose representatives are told by Hall's condition inside Catalyst; for more, paths are searched.
HALL_SETS = 3


def intersect(*sets: Column) -> Column:
    return reduce(F.array_intersect, sets)


def without(s: Column, keys: list[Column]) -> Column:
    return F.array_except(s, F.array(*keys)) if keys else s


def size(s: Column) -> Column:
    return F.size(s).cast("bigint")


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def partitions(items: list) -> list[list[list]]:
    """All partitions of a list into blocks."""
    if not items:
        return [[]]
    first, out = items[0], []
    for rest in partitions(items[1:]):
        out.append([[first], *rest])
        out += [[*rest[:k], [first, *rest[k]], *rest[k + 1 :]] for k in range(len(rest))]
    return out


def distinct_tuples(sets: list[Column]) -> Column:
    """Tuples with one member of each set, all different: inclusion and exclusion over set partitions."""
    if not sets:
        return F.lit(1).cast("bigint")
    n = range(len(sets))
    shared = {c: size(intersect(*(sets[k] for k in c))) for r in range(1, len(sets) + 1) for c in combinations(n, r)}
    terms = []
    for blocks in partitions(list(n)):
        sign = (-1) ** (len(sets) - len(blocks))
        weight = sign * reduce(lambda a, b: a * factorial(len(b) - 1), blocks, 1)
        terms.append(reduce(lambda a, b: a * b, (shared[tuple(sorted(b))] for b in blocks)) * F.lit(weight).cast("bigint"))
    return reduce(lambda a, b: a + b, terms)


def matched(lists) -> bool:
    """Whether each list can stand for one of its members, all different: augmenting paths, in polynomial time."""
    owner: dict = {}

    def place(k: int, tried: set) -> bool:
        for x in lists[k]:
            if x not in tried:
                tried.add(x)
                if x not in owner or place(owner[x], tried):
                    owner[x] = k
                    return True
        return False

    return all(place(k, set()) for k in sorted(range(len(lists)), key=lambda k: len(lists[k])))


@F.pandas_udf(BooleanType())
def _all_matched(rows: pd.Series) -> pd.Series:
    return pd.Series([matched([list(x) for x in row]) for row in rows], dtype=bool)


def has_representatives(sets: list[Column]) -> Column:
    """Whether different representatives exist.

    A set with as many members as there are sets always finds one, whatever the others take, so no more than that
    many members of each are looked at.
    """
    n = len(sets)
    if n < 2:
        return reduce(lambda a, b: a & b, [F.size(s) > 0 for s in sets], F.lit(True))
    some = [F.slice(s, 1, n) for s in sets]
    if n > HALL_SETS:
        return _all_matched(F.array(*some))
    plenty = F.least(*(F.size(s) for s in sets)) >= n
    tests = [F.size(reduce(F.array_union, (some[k] for k in c))) >= r for r in range(1, n + 1) for c in combinations(range(n), r)]
    return plenty | reduce(lambda a, b: a & b, tests)
