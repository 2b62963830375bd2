"""Sequences of neighbourhood filters: (vertex, pivots) or, for matching filters, (vertex, None)."""

from __future__ import annotations

from graphloom.plans.pattern import Pattern

Sequence = list[tuple[int, list[int] | None]]


def levels_sequence(p: Pattern, root: int) -> Sequence:
    """By breadth-first levels: down by earlier neighbours, back by later ones of the level; at last up by the next level."""
    order, tree = p.bfs(root)
    place = {v: k for k, v in enumerate(order)}
    level = lambda v: tree[v].level
    out: Sequence = []
    last = max(level(v) for v in order)
    at = {d: [v for v in order if level(v) == d] for d in range(last + 1)}
    for d in range(last + 1):
        out += [(v, [w for w in p.adj[v] if level(w) < d or level(w) == d and place[w] < place[v]]) for v in at[d]]
        out += [(v, [w for w in p.adj[v] if level(w) == d and place[w] > place[v]]) for v in reversed(at[d])]
    for d in range(last - 1, -1, -1):
        out += [(v, [w for w in p.adj[v] if level(w) == d + 1]) for v in at[d]]
    return [(v, pivots) for v, pivots in out if pivots]


def sweeps_sequence(p: Pattern, root: int) -> Sequence:
    """Three sweeps over the breadth-first order: by earlier, by later, by earlier neighbours."""
    order, _ = p.bfs(root)
    place = {v: k for k, v in enumerate(order)}
    before = [(v, [w for w in p.adj[v] if place[w] < place[v]]) for v in order]
    after = [(v, [w for w in p.adj[v] if place[w] > place[v]]) for v in reversed(order)]
    return [(v, pivots) for v, pivots in before + after + before if pivots]


def tree_sequence(p: Pattern, root: int) -> Sequence:
    """Along the breadth-first tree in preorder: down by the parent, then back by the children."""
    _, tree = p.bfs(root)
    order = p.preorder(tree, root)
    return [(v, [tree[v].parent]) for v in order[1:]] + [(v, list(tree[v].children)) for v in reversed(order) if tree[v].children]


def matching_sequence(p: Pattern, rounds: int = 2) -> Sequence:
    return [(v, None) for _ in range(rounds) for v in range(p.n)]
