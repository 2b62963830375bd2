"""Start vertices and matching orders."""

from __future__ import annotations

import heapq
from math import inf

from graphloom.plans.pattern import Pattern


def dense_start(p: Pattern, sizes) -> int:
    """Fewest candidates per edge among vertices with more than one edge (all, if there is none)."""
    pool = [v for v in range(p.n) if p.degree(v) > 1] or range(p.n)
    return min(pool, key=lambda v: (sizes[v] / max(1, p.degree(v)), v))


def core_start(p: Pattern, sizes, frequencies) -> int:
    """Of the three rarest labels per edge in the 2-core (or everywhere), the one with fewest candidates per edge."""
    core = p.core_numbers()
    pool = [v for v in range(p.n) if core[v] > 1] or range(p.n)
    top = heapq.nsmallest(3, pool, key=lambda v: (frequencies.get(p.labels[v], 0) / max(1, p.degree(v)), v))
    return min(top, key=lambda v: (sizes[v] / max(1, p.degree(v)), v))


def rare_start(p: Pattern, sizes, frequencies, total: int) -> int:
    """Of the three rarest labels per edge, one with a label on at most 5 % of all vertices if there is one, with fewest candidates."""
    top = heapq.nsmallest(3, range(p.n), key=lambda v: (frequencies.get(p.labels[v], 0) / max(1, p.degree(v)), v))
    rare = [v for v in top if frequencies.get(p.labels[v], 0) <= 0.05 * total]
    return min(rare or top, key=lambda v: (sizes[v], v))


def matching_order(p: Pattern, sizes, among=None) -> list[int]:
    """Start where candidates per edge are fewest (among the given vertices); go on to seen vertices, core first, fewest candidates."""
    core = p.core_numbers()
    start = min(among or range(p.n), key=lambda v: (sizes[v] / p.degree(v) if p.degree(v) else inf if p.n > 1 else 0, v))
    order, seen, heap = [], {start}, [(0, 0, start)]
    while heap:
        v = heapq.heappop(heap)[2]
        order.append(v)
        for w in p.adj[v]:
            if w not in seen:
                seen.add(w)
                heapq.heappush(heap, (core[w] <= 1, sizes[w], w))
    return order


def checked_order(p: Pattern, order) -> list[int]:
    order = [int(v) for v in order]
    if sorted(order) != list(range(p.n)):
        raise ValueError(f"the order {order} is no permutation of the pattern's vertices")
    for k, v in enumerate(order[1:], 1):
        if not set(p.adj[v]) & set(order[:k]):
            raise ValueError(f"vertex {v} has no neighbour before it in the order {order}")
    return order
