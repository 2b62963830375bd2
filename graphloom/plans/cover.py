"""Minimum vertex covers of the pattern, unweighted and weighted; all optima.

What a cover leaves out is an independent set, so the heaviest independent sets are looked for: a
recursion over bit masks of undecided vertices that remembers every mask it has solved, part by
connected part.
"""

from __future__ import annotations

from itertools import islice, product

from graphloom.plans.pattern import Pattern


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class _Independent:
    """Heaviest independent sets within a mask of vertices."""

    def __init__(self, near: list[int], weights: list[float]):
        self.near, self.weights, self.known = near, weights, {0: 0.0}

    def parts(self, mask: int) -> list[int]:
        out = []
        while mask:
            part = todo = mask & -mask
            while todo:
                grown = 0
                for v in _bits(todo):
                    grown |= self.near[v]
                todo = grown & mask & ~part
                part |= todo
            out.append(part)
            mask &= ~part
        return out

    def split(self, mask: int) -> tuple[int, int, int]:
        """The vertex to decide, and what stays undecided if it is taken or left."""
        v = max(_bits(mask), key=lambda u: ((self.near[u] & mask).bit_count(), -u))
        return v, mask & ~self.near[v] & ~(1 << v), mask & ~(1 << v)

    def weight(self, mask: int) -> float:
        if mask not in self.known:
            parts = self.parts(mask)
            if len(parts) > 1:
                self.known[mask] = sum(map(self.weight, parts))
            else:
                v, taken, left = self.split(mask)
                self.known[mask] = max(self.weights[v] + self.weight(taken), self.weight(left))
        return self.known[mask]

    def sets(self, mask: int):
        """All heaviest sets, one after another."""
        if not mask:
            yield 0
            return
        parts = self.parts(mask)
        if len(parts) > 1:
            for found in product(*(list(islice(self.sets(p), 64)) for p in parts)):
                yield sum(found)
            return
        v, taken, left = self.split(mask)
        best, eps = self.weight(mask), 1e-9
        if self.weights[v] + self.weight(taken) >= best - eps:
            for s in self.sets(taken):
                yield s | 1 << v
        if self.weight(left) >= best - eps:
            yield from self.sets(left)


def minimum_covers(n: int, edges, weights=None, required=(), most: int = 64) -> tuple[float, list[frozenset[int]]]:
    """(least weight, the covers of that weight). ``required`` vertices are in every cover, for free.

    Ties multiply with a pattern's symmetry; ``most`` of them are returned.
    """
    w = [1.0] * n if weights is None else [float(x) for x in weights]
    fixed, near = frozenset(required), [0] * n
    for a, b in edges:
        if a not in fixed and b not in fixed:
            near[a] |= 1 << b
            near[b] |= 1 << a
    live = sum(1 << v for v in range(n) if near[v])
    independent = _Independent(near, w)
    covers = {frozenset(_bits(live & ~s)) | fixed for s in islice(independent.sets(live), most)}
    return sum(w[v] for v in _bits(live)) - independent.weight(live), sorted(covers, key=sorted)


def smallest(covers: list[frozenset[int]]) -> frozenset[int]:
    """The cover with the fewest vertices, the first among equals."""
    return min(covers, key=lambda c: (len(c), sorted(c)))


def is_cover(cover, edges) -> bool:
    return all(a in cover or b in cover for a, b in edges)


def prefix_edges(p: Pattern, prefix) -> list[tuple[int, int]]:
    return [(a, b) for a, b in p.edges if a in prefix and b in prefix]


def long_run(near: dict[int, set[int]], alone, sizes) -> tuple[int, list[int], int] | None:
    """(end, run, end): a run of vertices of ``alone`` with two neighbours each that covers need more keys for than its ends; None if there is none.

    Between different ends that takes two vertices. A run back to where it starts, or a ring, takes a cycle of five, and goes
    to the vertex halfway round. The end with fewer candidates comes first.
    """
    inner = {v for v in near if v in alone and len(near[v]) == 2}
    for start in sorted(set(near) - inner) or sorted(near, key=lambda v: (sizes[v], v))[:1]:
        for first in sorted(near[start]):
            run, last, at = [], start, first
            while at in inner and at != start:
                run.append(at)
                (ahead,) = near[at] - {last}
                last, at = at, ahead
            if at != start and len(run) > 1:
                return (start, run, at) if sizes[start] <= sizes[at] else (at, run[::-1], start)
            if at == start and len(run) > 3:
                half = len(run) // 2
                return start, run[:half], run[half]
    return None
