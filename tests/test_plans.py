"""Driver-side planning: covers, orders, filter sequences, configuration."""

import random
import time
from itertools import combinations
from math import prod

import pytest

from graphloom.engine import Config
from graphloom.plans import cover, order, planner, pruning
from graphloom.plans.pattern import Pattern
from graphloom.sources.text import read_pattern


def _random_pattern(rng, n):
    edges = [(i, rng.randrange(i)) for i in range(1, n)]
    edges += [e for e in combinations(range(n), 2) if rng.random() < 0.3]
    return Pattern([rng.randrange(3) for _ in range(n)], edges)


def test_all_minimum_covers_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        p = _random_pattern(rng, rng.randrange(2, 9))
        weights = [rng.choice([1, 1, 2, 3]) for _ in range(p.n)]
        every = [frozenset(c) for k in range(p.n + 1) for c in combinations(range(p.n), k) if cover.is_cover(c, p.edges)]
        least = min(sum(weights[v] for v in c) for c in every)
        best, found = cover.minimum_covers(p.n, p.edges, weights)
        assert best == pytest.approx(least)
        assert set(found) == {c for c in every if sum(weights[v] for v in c) == least}


def test_complete_graph_has_five_covers_of_four():
    best, found = cover.minimum_covers(5, list(combinations(range(5), 2)))
    assert (best, len(found)) == (4, 5)


def test_plans_keep_their_rules():
    rng = random.Random(2)
    for _ in range(60):
        p = _random_pattern(rng, rng.randrange(2, 8))
        sizes = [rng.randrange(1, 500) for _ in range(p.n)]
        o = order.checked_order(p, order.matching_order(p, sizes))
        for strategy in planner.STRATEGIES:
            made = planner.plan(p, o, sizes, strategy)
            for k in range(p.n):
                prefix = set(o[: k + 1])
                assert cover.is_cover(made.keys(k), [e for e in p.edges if set(e) <= prefix])
                assert k == 0 or made.keys(k - 1) <= made.keys(k)


def test_large_patterns_are_planned_in_time():
    rng = random.Random(4)
    shapes = [Pattern([k % 3 for k in range(32)], [(k, k + 1) for k in range(31)]), Pattern([0] * 32, [(0, k) for k in range(1, 32)]), Pattern([k % 2 for k in range(16)], [(k, (k - 1) // 2) for k in range(1, 16)]), _random_pattern(rng, 24), Pattern([0] * 12, list(combinations(range(12), 2)))]
    for p in shapes:
        sizes = [rng.randrange(5, 5000) for _ in range(p.n)]
        o = order.matching_order(p, sizes)
        costs = {}
        for strategy in ("static", "eager", "dynamic"):
            began = time.monotonic()
            made = planner.plan(p, o, sizes, strategy)
            assert time.monotonic() - began < 1.5
            costs[strategy] = planner._cost(p, o, made.key_at, sizes)
            for k in range(p.n):
                assert cover.is_cover(made.keys(k), cover.prefix_edges(p, set(o[: k + 1])))
        assert costs["dynamic"] <= 1.001 * min(costs.values())


def test_dynamic_covers_are_the_cheapest_chains():
    rng = random.Random(6)
    for _ in range(25):
        p = _random_pattern(rng, rng.randrange(3, 7))
        sizes = [rng.randrange(2, 400) for _ in range(p.n)]
        o = order.matching_order(p, sizes)
        size = lambda c: prod(sizes[v] for v in c)
        best = {frozenset({o[0]}): size({o[0]})}
        for k in range(1, p.n):
            prefix = o[: k + 1]
            every = [frozenset({o[0], *c}) for r in range(k + 1) for c in combinations(prefix[1:], r) if cover.is_cover({o[0], *c}, cover.prefix_edges(p, set(prefix)))]
            best = {c: min(x for b, x in best.items() if b <= c) + (size(c) if k < p.n - 1 else 0) for c in every if any(b <= c for b in best)}
        made = planner.plan(p, o, sizes, "dynamic")
        assert planner._cost(p, o, made.key_at, sizes) == pytest.approx(min(best.values()))


def test_sides_of_a_set():
    assert [planner.side(a, b) for a, b in ((800, 100), (100, 50), (100, 90))] == ["candidate", "extension", "parent"]


def test_core_numbers_and_induced_subgraph():
    p = Pattern([0] * 5, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)])
    assert p.core_numbers() == [2, 2, 2, 1, 1]
    assert p.induced([2, 3, 0]).edges == ((0, 1), (0, 2))


def test_sequences_filter_by_neighbours_only():
    rng = random.Random(3)
    for _ in range(20):
        p = _random_pattern(rng, 6)
        for f in (pruning.levels_sequence, pruning.sweeps_sequence, pruning.tree_sequence):
            assert all(w in p.adj[v] for v, pivots in f(p, 0) for w in pivots)


def test_configuration():
    c = Config.parse("candidate_pruning_strategy=gql, mo=2 0 1, cs=eager, limit=25")
    assert (c.pruning, c.order, c.compression, c.limit) == ("gql", [2, 0, 1], "eager", 25)
    assert Config.parse("limit=0").limit is None
    for bad in ("cps=best", "cs=zip", "cps", "speed=9"):
        with pytest.raises(ValueError):
            Config.parse(bad)


def test_orders_are_checked():
    p = Pattern([0, 0, 0], [(0, 1), (1, 2)])
    for bad in ([0, 2, 1], [0, 1], [0, 1, 1]):
        with pytest.raises(ValueError):
            order.checked_order(p, bad)


def test_pattern_text():
    p = read_pattern("t 3 2\nv 7 1 1\nv 8 2 2\nv 9 1 1\ne 7 8\ne 8 9 0\n")
    assert (p.labels, p.edges) == ((1, 2, 1), ((0, 1), (1, 2)))
