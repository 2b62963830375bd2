"""Which pattern vertices are keys (one value a row) and which are sets (an array a row), and when.

A cover of the pattern's edges becomes keys; the other vertices are pairwise not adjacent, so their
candidates can stay sets that are independent but for distinctness. The root is always a key: a set
of all its candidates would be one unbounded row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import islice
from math import log2, prod

from graphloom.plans.cover import minimum_covers, smallest
from graphloom.plans.pattern import Pattern

STRATEGIES = ("none", "static", "eager", "dynamic", "sample")


@dataclass
class Step:
    """Match ``vertex`` as a key or a set; ``promote`` sets become keys before."""

    vertex: int
    kind: str
    #: By which side a set parent's members and the target's candidates are brought together.
    how: str = ""
    key_parents: list[int] = field(default_factory=list)
    set_parents: list[int] = field(default_factory=list)
    promote: list[int] = field(default_factory=list)

    @property
    def operator(self) -> str:
        """Name of the operator that the parents' and the target's kinds call for."""
        if not self.key_parents and not self.set_parents:
            return "scan"
        if self.kind == "set":
            base = "key_to_set" if len(self.key_parents) == 1 else "keys_to_set"
            return f"enumerate+{base}" if self.promote else base
        if not self.key_parents:
            return f"set_to_key{'_by_' + self.how if self.how else ''}" if len(self.set_parents) == 1 else "sets_to_key"
        base = "key_to_key" if len(self.key_parents) == 1 else "keys_to_key"
        return f"{base}+into" if self.set_parents else base


@dataclass
class Plan:
    pattern: Pattern
    order: list[int]
    key_at: dict[int, int]
    steps: list[Step]

    def keys(self, level: int) -> frozenset[int]:
        """Key vertices once level ``level`` is matched."""
        return frozenset(v for v in self.order[: level + 1] if self.key_at.get(v, len(self.order)) <= level)

    def explain(self) -> str:
        lines = [f"order: {' '.join(map(str, self.order))}"]
        for k, s in enumerate(self.steps):
            text = f"{k}: {s.operator} -> {s.kind} {s.vertex} (label {self.pattern.labels[s.vertex]})"
            for name, of in (("keys", s.key_parents), ("sets", s.set_parents), ("to keys", s.promote)):
                text += f"; {name} {of}" if of else ""
            lines.append(text)
        return "\n".join(lines)


def build(p: Pattern, order: list[int], key_at: dict[int, int]) -> Plan:
    """Steps from the level at which each vertex becomes a key (absent: never)."""
    place = {v: k for k, v in enumerate(order)}
    key_at = {v: max(k, place[v]) for v, k in key_at.items()} | {order[0]: 0}
    steps = []
    for k, v in enumerate(order):
        before = [w for w in p.adj[v] if place[w] < k]
        promote = [w for w in order[:k] if key_at.get(w) == k]
        is_key = lambda w: key_at.get(w, p.n) <= k
        steps.append(Step(v, "key" if key_at.get(v) == k else "set", key_parents=[w for w in before if is_key(w)], set_parents=[w for w in before if not is_key(w)], promote=promote))
        if steps[-1].kind == "set" and steps[-1].set_parents:
            raise ValueError(f"set vertex {v} has a set parent in {order}")
    return Plan(p, order, key_at, steps)


def _weights(sizes) -> list[float]:
    return [log2(max(2, s)) for s in sizes]


def covers(p: Pattern, sizes) -> list[frozenset[int]]:
    """The lightest covers by candidates; ties are kept."""
    return minimum_covers(p.n, p.edges, _weights(sizes))[1]


def _eager(p: Pattern, order: list[int], cover: frozenset[int]) -> dict[int, int]:
    """A cover's vertex is a key as soon as a set stands beside it: at its own level, or when the first one is matched later."""
    place, key_at = {v: k for k, v in enumerate(order)}, {order[0]: 0}
    for v in order[1:]:
        if v in cover:
            beside = any(key_at.get(w, p.n) > place[v] for w in p.adj[v] if place[w] < place[v])
            later = [place[w] for w in p.adj[v] if place[w] > place[v] and w not in cover]
            if beside or later:
                key_at[v] = place[v] if beside else min(later)
    return key_at


def _cost(p: Pattern, order: list[int], key_at: dict[int, int], sizes) -> float:
    plan = build(p, order, key_at)
    return sum(prod(max(1, sizes[v]) for v in plan.keys(k)) for k in range(p.n - 1))


#: Chains of covers followed at once from level to level; patterns of up to 13 vertices have no more.
CHAINS = 4096


def _dynamic(p: Pattern, order: list[int], sizes) -> dict[int, int]:
    """Least sum over levels of key combinations, over chains of growing covers of the prefixes.

    A new vertex's edges to sets are covered by the vertex or by all those sets; nothing else need become a
    key at its level, as keys multiply from then on. Of more chains than CHAINS the cheapest go on; the
    other strategies' chains are looked at as well.
    """
    place = {v: k for k, v in enumerate(order)}
    chains: dict[frozenset[int], tuple[float, dict[int, int]]] = {frozenset({order[0]}): (float(max(1, sizes[order[0]])), {order[0]: 0})}
    for k, v in enumerate(order[1:], 1):
        found: dict[frozenset[int], tuple[float, dict[int, int]]] = {}
        for held, (cost, key_at) in chains.items():
            beside = frozenset(w for w in p.adj[v] if place[w] < k and w not in held)
            for more in ({frozenset({v}), beside} if beside else {frozenset()}):
                now = held | more
                total = cost + (prod(max(1, sizes[w]) for w in now) if k < p.n - 1 else 0)
                if now not in found or total < found[now][0]:
                    found[now] = (total, key_at | dict.fromkeys(more, k))
        chains = dict(sorted(found.items(), key=lambda x: (x[1][0], len(x[0]), sorted(x[0])))[:CHAINS])
    choices = [key_at for _, key_at in islice(chains.values(), 1)]
    for cover in covers(p, sizes):
        choices += [_eager(p, order, cover), {v: place[v] for v in cover}]
    return min(choices, key=lambda key_at: _cost(p, order, key_at, sizes))


def side(parent: int, target: int) -> str:
    """How a set meets a new key, by the candidates of either: gathered under each target by its members, shrunk to what the target has, or met from the targets' lists."""
    if 8 * target <= parent:
        return "candidate"
    return "extension" if 2 * target <= parent else "parent"


def plan(p: Pattern, order: list[int], sizes, strategy: str = "dynamic", forced=()) -> Plan:
    """The steps for an order, by the strategy's choice of keys; the ``forced`` vertices are keys from their level on."""
    made = _plan(p, order, sizes, strategy)
    if any(made.key_at.get(v) != order.index(v) for v in forced):
        made = build(p, order, made.key_at | {v: order.index(v) for v in forced})
    for step in made.steps:
        if step.kind == "key" and not step.key_parents and len(step.set_parents) == 1:
            step.how = side(sizes[step.set_parents[0]], sizes[step.vertex])
    return made


def _plan(p: Pattern, order: list[int], sizes, strategy: str) -> Plan:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown compression {strategy!r}; one of {', '.join(STRATEGIES)}")
    place = {v: k for k, v in enumerate(order)}
    if strategy == "none" or p.n == 1:
        return build(p, order, place)
    if strategy == "static":
        return build(p, order, {v: place[v] for v in smallest(covers(p, sizes))})
    if strategy == "eager":
        return build(p, order, min((_eager(p, order, c) for c in covers(p, sizes)), key=lambda k: (_cost(p, order, k, sizes), sorted(k.items()))))
    return build(p, order, _dynamic(p, order, sizes))


def analyse(p: Pattern, order: list[int], sizes) -> list[dict]:
    """For each strategy: keys by level, levels at which keys come late, cost."""
    out = []
    place = {v: k for k, v in enumerate(order)}
    for s in STRATEGIES[:4]:
        made = plan(p, order, sizes, s)
        out.append({"strategy": s, "keys": [sorted(made.keys(k)) for k in range(p.n)], "late": {v: k - place[v] for v, k in made.key_at.items() if k > place[v]}, "cost": _cost(p, order, made.key_at, sizes)})
    return out
