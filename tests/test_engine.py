"""Counts against closed forms and a brute-force matcher; sources; filters."""

import random
from itertools import combinations, permutations

import pytest

from graphloom.engine import Config, Query, count
from graphloom.functions.sets import has_representatives, matched, partitions
from graphloom.graph import LabeledGraph
from graphloom.operators import output
from graphloom.plans.pattern import Pattern
from graphloom.sources import text


def _graph(spark, labels, edges):
    return LabeledGraph.from_tables(spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id bigint, label int"), spark.createDataFrame(edges, "src bigint, dst bigint")).persist()


def _brute(labels, edges, p):
    near = {(a, b) for e in edges for a, b in (e, e[::-1]) if a != b}
    return [f for f in permutations(range(len(labels)), p.n) if all(labels[f[v]] == p.labels[v] for v in range(p.n)) and all((f[a], f[b]) in near for a, b in p.edges)]


K5 = list(combinations(range(5), 2))
GRID = [(3 * r + c, 3 * r + c + 1) for r in range(3) for c in range(2)] + [(3 * r + c, 3 * r + c + 3) for r in range(2) for c in range(3)]


def test_complete_graph_and_grid(spark):
    k5, grid = _graph(spark, [0] * 5, K5), _graph(spark, [0] * 9, GRID)
    star, square, path = Pattern([0] * 4, [(0, 1), (0, 2), (0, 3)]), Pattern([0] * 4, [(0, 1), (1, 2), (2, 3), (3, 0)]), Pattern([0] * 3, [(0, 1), (1, 2)])
    fast = Config(pruning="ldf", compression="static")
    assert count(k5, Pattern([0, 0], [(0, 1)]), fast) == 20
    assert count(k5, Pattern([0] * 3, [(0, 1), (1, 2), (0, 2)]), fast) == 60
    assert count(k5, star, fast) == 120
    assert count(k5, square, fast) == 120
    assert count(grid, path, fast) == 44
    assert count(grid, square, fast) == 32
    assert count(grid, Pattern([0] * 3, [(0, 1), (1, 2), (0, 2)]), fast) == 0
    assert count(grid, Pattern([0], []), fast) == 9
    assert count(grid, Pattern([7, 0], [(0, 1)]), fast) == 0
    assert count(k5, star, "cps=ldf,cs=static,limit=7") == 7


def test_random_graphs_by_every_strategy(spark):
    rng = random.Random(5)
    choices = [("none", "none"), ("ldf", "static"), ("nlf", "eager"), ("cfl", "dynamic"), ("daf", "static"), ("gql", "dynamic"), ("tso", "sample")]
    patterns = [Pattern([0, 1, 1, 0], [(0, 1), (0, 2), (1, 3), (2, 3)]), Pattern([0, 0, 0, 1], [(0, 1), (0, 2), (0, 3)]), Pattern([1, 0, 2, 0, 0], [(0, 1), (1, 2), (2, 3), (0, 3), (2, 4)])]
    for k, p in enumerate(patterns):
        labels = [rng.randrange(3) for _ in range(10)]
        edges = [e for e in combinations(range(10), 2) if rng.random() < 0.45]
        g, want = _graph(spark, labels, edges), _brute(labels, edges, p)
        for pruning, compression in choices[k::2] + choices[:1]:
            q = Query(g, p, Config(pruning=pruning, compression=compression))
            assert q.count().first()["n"] == len(want), (pruning, compression)
        q = Query(g, p, Config(pruning="nlf", compression="static"))
        got = {tuple(r[f"u{v}"] for v in range(p.n)) for r in q.rows().collect()}
        assert got == set(want)
        steps = q.profile()
        assert steps[-1]["out_subgraphs"] == len(want) and len(steps) == p.n


def test_hubs_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr("graphloom.engine.SET_SIZE", 2)
    rng = random.Random(15)
    labels = [rng.randrange(2) for _ in range(11)]
    edges = [e for e in combinations(range(11), 2) if rng.random() < 0.6]
    g = _graph(spark, labels, edges)
    for p in (Pattern([0, 1, 1, 0], [(0, 1), (0, 2), (1, 3), (2, 3)]), Pattern([0, 1, 1, 1], [(0, 1), (0, 2), (0, 3)]), Pattern([1, 0, 1, 0, 0], [(0, 1), (1, 2), (2, 3), (0, 3), (2, 4)])):
        want = set(_brute(labels, edges, p))
        for how in ("static", "eager", "dynamic"):
            q = Query(g, p, Config(pruning="ldf", compression=how))
            assert q.parts > 1 and q.count().first()["n"] == len(want)
            assert {tuple(r[f"u{v}"] for v in range(p.n)) for r in q.rows().collect()} == want


def test_hanging_trees_are_summed_up(spark):
    rng = random.Random(16)
    labels = [k % 6 for k in range(18)]
    edges = [e for e in combinations(range(18), 2) if rng.random() < 0.35]
    g = _graph(spark, labels, edges)
    tree = Pattern([0, 1, 2, 3, 4], [(0, 1), (1, 2), (1, 3), (0, 4)])
    tailed = Pattern([0, 0, 1, 2, 3], [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)])
    shared = Pattern([0, 1, 1, 2], [(0, 1), (0, 2), (2, 3)])
    for p in (tree, tailed, shared):
        for how in ("static", "dynamic"):
            q = Query(g, p, Config(pruning="ldf", compression=how))
            assert q.count().first()["n"] == len(_brute(labels, edges, p))
    assert Query(g, tree, Config(pruning="ldf")).folded()[0].p.n == 1
    assert Query(g, tailed, Config(pruning="ldf")).folded()[0].p.n == 3
    assert Query(g, Pattern([0] * 3, [(0, 1), (1, 2)]), Config(pruning="ldf")).folded() is None


def test_representatives():
    rng = random.Random(17)
    for _ in range(300):
        lists = [rng.sample(range(6), rng.randrange(0, 5)) for _ in range(rng.randrange(1, 6))]
        hall = all(len(set().union(*c)) >= r for r in range(1, len(lists) + 1) for c in combinations(lists, r))
        assert matched(lists) == hall
    assert not matched([[1, 2, 3]] * 20 + [[9]])


def test_representatives_of_columns(spark):
    rng = random.Random(18)
    for n in (2, 3, 5):
        rows = [tuple(sorted(rng.sample(range(7), rng.randrange(1, 5))) for _ in range(n)) for _ in range(40)]
        table = spark.createDataFrame(rows, ", ".join(f"s{k} array<bigint>" for k in range(n)))
        got = table.withColumn("ok", has_representatives([table[f"s{k}"] for k in range(n)])).collect()
        assert [r["ok"] for r in got] == [matched([list(x) for x in r[:n]]) for r in got]


def test_large_stars_are_filtered_by_matching(spark):
    labels, edges = [1] + [0] * 12, [(0, i) for i in range(1, 13)]
    star = Pattern([1] + [0] * 12, [(0, i) for i in range(1, 13)])
    assert Query(_graph(spark, labels, edges), star, Config(pruning="gql")).sizes[0] == 1
    assert Query(_graph(spark, labels[:-1], edges[:-1]), star, Config(pruning="gql")).sizes[0] == 0


def test_limits(spark):
    g, star = _graph(spark, [0] * 9, GRID), Pattern([0] * 3, [(0, 1), (1, 2)])
    for limit, want in ((1, 1), (43, 43), (44, 44), (1000, 44)):
        assert count(g, star, Config(pruning="ldf", compression="static", limit=limit)) == want
        assert Query(g, star, Config(pruning="ldf", limit=limit)).rows().count() == want


def test_rows_are_written_and_described(spark, tmp_path):
    g, tri = _graph(spark, [0] * 5, K5), Pattern([0] * 3, [(0, 1), (1, 2), (0, 2)])
    q = Query(g, tri, Config(pruning="ldf", compression="static"))
    q.write(str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 60
    texts = [r["value"] for r in output.described(q.relation).collect()]
    assert len(texts) == q.relation.count() and all(t.count(":") == 3 for t in texts)
    assert "set" in q.explain() and q.explain().startswith("pruning ldf")
    every = q.relation.agg({"k_0": "count"}).first()[0]
    assert output.existing(q.relation, tri).count() == every


def test_more_sets_than_the_closed_form_takes(spark):
    labels, edges = [1] + [0] * 8, [(0, i) for i in range(1, 9)]
    star = Pattern([1] + [0] * 7, [(0, i) for i in range(1, 8)])
    assert count(_graph(spark, labels, edges), star, Config(pruning="none", compression="static")) == 40320


def test_set_partitions():
    assert [len(partitions(list(range(n)))) for n in range(6)] == [1, 1, 2, 5, 15, 52]


def test_matching_filter_needs_different_neighbours(spark):
    # both pattern neighbours of vertex 0 can only be vertex 1
    g = _graph(spark, [5, 6, 7, 7], [(0, 1), (1, 2), (1, 3), (0, 2)])
    p = Pattern([5, 6, 6], [(0, 1), (0, 2)])
    assert Query(g, p, Config(pruning="gql")).sizes[0] == 0


def test_text_and_parquet_round_trip(spark, tmp_path):
    g = _graph(spark, [3, 1, 1, 2], [(0, 1), (1, 2), (2, 2), (2, 1), (3, 0)])
    text.write_text(g, str(tmp_path / "t"))
    again = text.read_text(spark, str(tmp_path / "t"))
    text.convert(spark, str(tmp_path / "t"), str(tmp_path / "p"))
    loaded = text.load(spark, str(tmp_path / "p"))
    for other in (again, loaded):
        assert sorted(map(tuple, other.edges.collect())) == sorted(map(tuple, g.edges.collect()))
        assert sorted(map(tuple, other.vertices.collect())) == sorted(map(tuple, g.vertices.collect()))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines[0] == "t 4 3"
    (tmp_path / "bad").write_text("t 2 1\nv 0 1 0\n")
    with pytest.raises(ValueError):
        text.read_text(spark, str(tmp_path / "bad"))


def test_parts(spark):
    g = _graph(spark, [0] * 9, GRID)
    cut = g.edge_cut(4).first()
    assert cut["edges"] == 12 and 0 <= cut["cut"] <= 12
    assert sum(g.label_range(0, part, 4).count() for part in range(4)) == 9 == g.parts(4, 2).count()
    assert g.summary().first()["n_edges"] == 12


def test_disconnected_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        Query(_graph(spark, [0, 0], [(0, 1)]), Pattern([0, 0], []))


def test_runs_between_two_vertices_and_long_cycles(spark):
    rng = random.Random(8)
    ring = lambda n: [(k, (k + 1) % n) for k in range(n)]
    patterns = [
        Pattern(range(10), ring(10)),
        Pattern(range(5), ring(5)),
        Pattern([*range(6), 0], [*ring(6), (5, 6)]),  # a cycle that hangs at one vertex
        Pattern([0, 1, 2, 3, 4, 0, 5], [(0, 1), (1, 2), (2, 5), (0, 3), (3, 4), (4, 5), (4, 6)]),  # two runs, ends of one label, a tip
        Pattern([0, 1, 2, 0, 0], [(0, 1), (1, 2), (2, 3), (0, 3), (0, 4), (3, 4)]),  # a run beside an edge
    ]
    for p in patterns:
        labels = [k % (max(p.labels) + 1) for k in range(20)]
        edges = [e for e in combinations(range(20), 2) if rng.random() < 0.6]
        near, partial = {(a, b) for e in edges for a, b in (e, e[::-1])}, [()]
        for v in range(p.n):
            back = [w for w in p.adj[v] if w < v]
            partial = [(*f, x) for f in partial for x in range(20) if labels[x] == p.labels[v] and x not in f and all((f[w], x) in near for w in back)]
        g = _graph(spark, labels, edges)
        q = Query(g, p, Config(pruning="ldf"))
        assert partial and q.count().first()["n"] == len(partial), p.edges
        # the run is summed up, not listed
        assert q.folded()[0].p.n < min(p.n, 5)
