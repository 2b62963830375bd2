"""Registered queries of the graph engine, over graphs derived from the driver's tables, with SQL for each."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import functions as F

from graphloom.engine import Config, Query
from graphloom.functions.sets import distinct_tuples, has_representatives, intersect, overlap, without
from graphloom.operators import expand as X
from graphloom.operators import output, scan
from graphloom.plans import order as orders
from graphloom.plans import planner, pruning
from graphloom.plans.cover import minimum_covers
from graphloom.plans.pattern import Pattern
from graphloom.sources import text
from graphloom.sources.tables import SPAN, graph
from graphloom.work import work_dir

#: Patterns over part brands.
PATTERNS = {
    "edge": Pattern([1, 2], [(0, 1)]),
    "path4": Pattern([1, 2, 3, 4], [(0, 1), (1, 2), (2, 3)]),
    "triangle": Pattern([1, 10, 11], [(0, 1), (1, 2), (0, 2)]),
    "square": Pattern([1, 2, 3, 2], [(0, 1), (1, 2), (2, 3), (3, 0)]),
    "diamond": Pattern([1, 2, 3, 3], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]),
    "clique4": Pattern([1, 2, 3, 4], list(combinations(range(4), 2))),
    "star3_same_label": Pattern([2, 1, 1, 3], [(0, 1), (0, 2), (0, 3)]),
    "tailed_triangle": Pattern([1, 10, 11, 5], [(0, 1), (1, 2), (0, 2), (2, 3)]),
    "house5": Pattern([1, 2, 3, 4, 5], [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4)]),
    "bowtie": Pattern([1, 2, 3, 2, 3], [(0, 1), (1, 2), (0, 2), (0, 3), (3, 4), (0, 4)]),
}
_PRUNED = PATTERNS["diamond"]

_P = """v AS MATERIALIZED (SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS label FROM part),
x AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT a.p AS src, b.p AS dst FROM x a JOIN x b ON a.o = b.o AND a.p <> b.p),
le AS MATERIALIZED (SELECT src, dst, a.label AS sl, b.label AS dl FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst),
deg AS MATERIALIZED (SELECT v.id, v.label, count(e.src)::INT AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY ALL)"""
_H = f"""v AS MATERIALIZED (SELECT 0 * {SPAN} + r_regionkey AS id, 0 AS label FROM region UNION ALL SELECT 1 * {SPAN} + n_nationkey, 1 FROM nation UNION ALL SELECT 2 * {SPAN} + c_custkey, 2 FROM customer
 UNION ALL SELECT 3 * {SPAN} + s_suppkey, 3 FROM supplier UNION ALL SELECT 4 * {SPAN} + p_partkey, 4 FROM part UNION ALL SELECT 5 * {SPAN} + o_orderkey, 5 FROM orders),
o1 AS (SELECT 1 * {SPAN} + n_nationkey AS a, 0 * {SPAN} + n_regionkey AS b FROM nation UNION SELECT 2 * {SPAN} + c_custkey, 1 * {SPAN} + c_nationkey FROM customer UNION SELECT 3 * {SPAN} + s_suppkey, 1 * {SPAN} + s_nationkey FROM supplier
 UNION SELECT 5 * {SPAN} + o_orderkey, 2 * {SPAN} + o_custkey FROM orders UNION SELECT 5 * {SPAN} + l_orderkey, 4 * {SPAN} + l_partkey FROM lineitem UNION SELECT 5 * {SPAN} + l_orderkey, 3 * {SPAN} + l_suppkey FROM lineitem UNION SELECT 4 * {SPAN} + l_partkey, 3 * {SPAN} + l_suppkey FROM lineitem),
e AS MATERIALIZED (SELECT a AS src, b AS dst FROM o1 UNION SELECT b, a FROM o1),
le AS MATERIALIZED (SELECT src, dst, a.label AS sl, b.label AS dl FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst)"""


def _matches_sql(p: Pattern) -> str:
    """CTEs m0, m1, ...: matches of growing prefixes, vertex by vertex."""
    order, out = p.bfs(0)[0], []
    for k, v in enumerate(order):
        before = order[:k]
        near = [w for w in p.adj[v] if w in before]
        if not k:
            out.append(f"m0 AS MATERIALIZED (SELECT id AS u{v} FROM v WHERE label = {p.labels[v]})")
            continue
        joins = " ".join(f"JOIN le e{w} ON e{w}.src = m.u{w} AND e{w}.sl = {p.labels[w]} AND e{w}.dl = {p.labels[v]}" + ("" if w == near[0] else f" AND e{w}.dst = e{near[0]}.dst") for w in near)
        differ = " AND ".join([f"e{near[0]}.dst <> m.u{w}" for w in before if p.labels[w] == p.labels[v]] or ["true"])
        out.append(f"m{k} AS MATERIALIZED (SELECT m.*, e{near[0]}.dst AS u{v} FROM m{k - 1} m {joins} WHERE {differ})")
    return ",\n".join(out)


def _count_sql(p: Pattern, base: str = _P, limit: int | None = None) -> str:
    n = f"least(count(*), {limit})" if limit else "count(*)"
    return f"WITH {base},\n{_matches_sql(p)}\nSELECT {n}::BIGINT AS n FROM m{p.n - 1}"


def _candidates_sql(p: Pattern, kind: str, root: int) -> str:
    """Candidates after a fixed filter sequence, filter by filter."""
    ctes, at = [_P], {}
    if kind == "cfl":
        ctes.append("mnd AS MATERIALIZED (SELECT src AS id, max(d.degree) AS mnd FROM e JOIN deg d ON d.id = e.dst GROUP BY 1)")
    for v in range(p.n):
        tests = [f"label = {p.labels[v]}", f"degree >= {p.degree(v)}"]
        if kind in ("nlf", "cfl", "gql", "tso"):
            tests += [f"(SELECT count(*) FROM le WHERE le.src = deg.id AND le.dl = {label}) >= {n}" for label, n in p.needs(v).items()]
        if kind == "cfl":
            tests.append(f"id IN (SELECT id FROM mnd WHERE mnd >= {max(p.degree(w) for w in p.adj[v])})")
        at[v] = f"c{v}_0"
        ctes.append(f"{at[v]} AS MATERIALIZED (SELECT id FROM deg WHERE {' AND '.join(tests)})")
    sequence = {"cfl": pruning.levels_sequence, "daf": pruning.sweeps_sequence, "tso": pruning.tree_sequence}.get(kind, lambda p, r: pruning.matching_sequence(p) if kind == "gql" else [])(p, root)
    for k, (v, pivots) in enumerate(sequence, 1):
        if pivots is None:
            tests = []
            for label in p.needs(v):
                group = [w for w in p.adj[v] if p.labels[w] == label]
                for r in range(1, len(group) + 1):
                    for c in combinations(group, r):
                        whole = " OR ".join(f"le.dst IN (SELECT id FROM {at[w]})" for w in c)
                        tests.append(f"(SELECT count(DISTINCT le.dst) FROM le WHERE le.src = c.id AND ({whole})) >= {r}")
        else:
            tests = [f"c.id IN (SELECT le.src FROM le JOIN {at[w]} p ON p.id = le.dst)" for w in pivots]
        ctes.append(f"c{v}_{k} AS MATERIALIZED (SELECT id FROM {at[v]} c WHERE {' AND '.join(tests)})")
        at[v] = f"c{v}_{k}"
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(f"SELECT {v}::INT AS qv, id FROM {c}" for v, c in at.items())


_found: dict[str, tuple] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _found[name] = (f, sql)
        return f

    return add


def _of(spark, sf, a: int, b: int):
    """Data edges between two labels of graph P."""
    return graph(spark, sf).edges.where((F.col("src_label") == a) & (F.col("dst_label") == b)).select("src", "dst")


# sources ------------------------------------------------------------------------------------------
_query("graph_summary", f"WITH {_P} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) // 2 FROM e) AS n_edges, (SELECT max(degree) FROM deg) AS max_degree, (SELECT count(DISTINCT label) FROM v) AS n_labels, (SELECT max(c) FROM (SELECT count(*) AS c FROM v GROUP BY label)) AS max_label_frequency")(lambda s, d: graph(s, d).summary())
_query("vertices_label_freq", f"WITH {_P} SELECT label, count(*) AS n FROM v GROUP BY 1")(lambda s, d: graph(s, d).label_freq)
_query("degree_stats", f"WITH {_P} SELECT id, label, degree FROM deg")(lambda s, d: graph(s, d).vertices.select("id", "label", "degree"))
_query("edge_list", f"WITH {_P} SELECT src, dst, sl AS src_label, dl AS dst_label FROM le")(lambda s, d: graph(s, d).edges.select("src", "dst", "src_label", "dst_label"))
_query("adj_label_slice", f"WITH {_P} SELECT src, dl AS nlabel, count(*) AS n, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM le WHERE dl IN (1, 2) GROUP BY 1, 2")(lambda s, d: graph(s, d).adjacency.where("nlabel in (1, 2)").select("src", "nlabel", "n", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs")))
_query("label_ranges", f"WITH {_P} SELECT label, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM v GROUP BY 1")(lambda s, d: graph(s, d).partitioned(20).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))
_PART0 = "pm0 AS MATERIALIZED (SELECT id, label, ((label * 31 + id // 64) % 20)::INT AS part FROM v)"
_CUT = "SELECT coalesce(sum((a.part <> b.part)::INT), 0)::BIGINT AS cut, count(*) AS edges FROM e JOIN {0} a ON a.id = src JOIN {0} b ON b.id = dst WHERE src < dst"


def _swap_sql(k: int) -> str:
    """One round of balanced swaps between parts, from pm{k - 1} to pm{k}."""
    return f"""near{k} AS MATERIALIZED (SELECT e.src AS id, o.part AS dest, count(*) AS c FROM e JOIN pm{k - 1} o ON o.id = e.dst GROUP BY ALL),
best{k} AS (SELECT id, o.part, arg_min(dest, (-c, dest)) AS dest, max(c) - coalesce(max(c) FILTER (dest = o.part), 0) AS gain FROM near{k} JOIN pm{k - 1} o USING (id) GROUP BY id, o.part),
move{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part, dest ORDER BY gain DESC, id) AS r FROM best{k} WHERE gain > 0),
size{k} AS MATERIALIZED (SELECT part, dest, count(*) AS n FROM move{k} GROUP BY ALL),
go{k} AS (SELECT m.id, m.dest FROM move{k} m JOIN size{k} a ON a.part = m.part AND a.dest = m.dest JOIN size{k} b ON b.part = m.dest AND b.dest = m.part WHERE r <= least(a.n, b.n)),
pm{k} AS MATERIALIZED (SELECT id, label, coalesce(dest, part)::INT AS part FROM pm{k - 1} LEFT JOIN go{k} USING (id))"""


_query("edge_cut_parts", f"WITH {_P}, {_PART0} {_CUT.format('pm0')}")(lambda s, d: graph(s, d).edge_cut(20))
_query("edge_cut_swapped", f"WITH {_P}, {_PART0}, {_swap_sql(1)}, {_swap_sql(2)} {_CUT.format('pm2')}")(lambda s, d: graph(s, d).edge_cut(20, rounds=2))
_query("partition_reorder", f"WITH {_P}, {_PART0}, {_swap_sql(1)} SELECT part, label, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY degree DESC, id) AS ids FROM pm1 JOIN deg USING (id, label) GROUP BY ALL")(
    lambda s, d: graph(s, d).partitioned(20, rounds=1).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "id"))), lambda x: x["id"].cast("string"))).alias("ids"))
)
_query("label_range_of_part", f"WITH {_P}, {_PART0} SELECT id FROM pm0 WHERE label = 3 AND part = 7")(lambda s, d: graph(s, d).label_range(3, 7))
_query("neighbours_with_label", f"WITH {_P} SELECT src, dst FROM le WHERE dl = 4")(lambda s, d: graph(s, d).neighbours(4))


def _path(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_ENDS = f"WITH {_P} SELECT src, dst, sl AS src_label, dl AS dst_label FROM le"


@_query("text_round_trip", _ENDS)
def text_round_trip(spark, sf_dir):
    """Edges of the graph that was written as text and read again."""
    path = _path(spark, "text")
    text.write_text(graph(spark, sf_dir), path)
    return text.read_text(spark, path).edges.select("src", "dst", "src_label", "dst_label")


_DUMP = f"WITH {_P} SELECT 't ' || (SELECT count(*) FROM v) || ' ' || (SELECT count(*) // 2 FROM e) AS value UNION ALL SELECT 'v ' || id || ' ' || label || ' ' || degree FROM deg UNION ALL SELECT 'e ' || src || ' ' || dst FROM e WHERE src < dst"


@_query("text_dump", _DUMP)
def text_dump(spark, sf_dir):
    """The lines of the text form."""
    path = _path(spark, "text")
    text.write_text(graph(spark, sf_dir), path)
    return spark.read.text(path)


@_query("parquet_round_trip", _ENDS)
def parquet_round_trip(spark, sf_dir):
    """Edges of the graph that was saved, clustered by label, and loaded again."""
    path = _path(spark, "saved")
    text.save(graph(spark, sf_dir), path)
    return text.load(spark, path).edges.select("src", "dst", "src_label", "dst_label")


@_query("converted", f"WITH {_P}, {_PART0}, {_swap_sql(1)} SELECT id, label, degree, part FROM pm1 JOIN deg USING (id, label)")
def converted(spark, sf_dir):
    """Vertices with their part, of the text form converted to Parquet."""
    path = _path(spark, "text")
    text.write_text(graph(spark, sf_dir), path)
    text.convert(spark, path, f"{path}-out", parts=20, rounds=1)
    return spark.read.parquet(f"{path}-out/parts").select("id", "label", "degree", F.col("part").cast("int").alias("part"))


# scans and local filters --------------------------------------------------------------------------
_query("ldf_scan", f"WITH {_P} SELECT id FROM deg WHERE label = 1 AND degree >= 3")(lambda s, d: scan.label_degree_scan(graph(s, d), 1, 3))
_query("degree_scan", f"WITH {_P} SELECT id FROM deg WHERE degree >= 100")(lambda s, d: scan.degree_scan(graph(s, d), 100))
for _kind, _root in (("ldf", 0), ("nlf", 0), ("cfl", 0), ("daf", 1), ("tso", 0), ("gql", 0)):
    _query(f"cand_{_kind}", _candidates_sql(_PRUNED, _kind, _root))(lambda s, d, k=_kind, r=_root: Query(graph(s, d), _PRUNED, Config(pruning=k, root=r)).candidate_table())
_query("mnd_nlf", _candidates_sql(PATTERNS["edge"], "cfl", 0).split(",\nc1_1")[0] + "\nSELECT 0::INT AS qv, id FROM c0_0 UNION ALL SELECT 1::INT, id FROM c1_0")(lambda s, d: scan.neighbour_labels(graph(s, d), PATTERNS["edge"], largest_degree=True))
_query("bipartite_index", f"WITH {_P}, l AS MATERIALIZED (SELECT DISTINCT src FROM le WHERE sl = 1 AND dl = 3), r AS MATERIALIZED (SELECT DISTINCT src AS dst FROM le WHERE sl = 2 AND dl = 3), b AS MATERIALIZED (SELECT src, dst FROM le WHERE sl = 1 AND dl = 2) SELECT src, dst FROM b JOIN l USING (src) JOIN r USING (dst)")(
    lambda s, d: X.candidate_edges(_of(s, d, 1, 2), _of(s, d, 1, 3).select(F.col("src").alias("id")), _of(s, d, 2, 3).select(F.col("src").alias("id")))
)
# set primitives: brand-1 and brand-2 ends of an edge and their brand-3 neighbours -----------------
_SETS = f"WITH {_P}, p AS MATERIALIZED (SELECT src AS a, dst AS b FROM le WHERE sl = 1 AND dl = 2), na AS MATERIALIZED (SELECT src AS a, dst AS x FROM le WHERE sl = 1 AND dl = 3), nb AS MATERIALIZED (SELECT src AS b, dst AS x FROM le WHERE sl = 2 AND dl = 3)"


def _pairs(s, d):
    """(a, b, x, y): ends of a brand 1 to 2 edge that both have brand-3 neighbours, with those."""
    left, right = X.adjacency(_of(s, d, 1, 3)).toDF("a", "part", "x").drop("part"), X.adjacency(_of(s, d, 2, 3)).toDF("b", "part", "y").drop("part")
    return _of(s, d, 1, 2).toDF("a", "b").join(left, "a").join(right, "b")


_BOTH = "WHERE a IN (SELECT a FROM na) AND b IN (SELECT b FROM nb)"
_COMMON = "(SELECT count(*) FROM na JOIN nb USING (x) WHERE na.a = p.a AND nb.b = p.b)"
_query("intersect_sets", f"{_SETS} SELECT a, b, {_COMMON}::INT AS n FROM p {_BOTH}")(lambda s, d: _pairs(s, d).select("a", "b", F.size(intersect(F.col("x"), F.col("y"))).alias("n")))
_query("except_sets", f"{_SETS} SELECT a, b, ((SELECT count(*) FROM na WHERE na.a = p.a) - (SELECT count(*) FROM na WHERE na.a = p.a AND na.x = (SELECT min(x) FROM nb WHERE nb.b = p.b)))::INT AS n FROM p {_BOTH}")(lambda s, d: _pairs(s, d).select("a", "b", F.size(without(F.col("x"), [F.col("y")[0]])).alias("n")))
_query("overlap_sets", f"{_SETS} SELECT a, b FROM p {_BOTH} AND {_COMMON} > 0")(lambda s, d: _pairs(s, d).where(overlap(F.col("x"), F.col("y"))).select("a", "b"))
_query("hall_prune", f"{_SETS} SELECT a, b FROM p {_BOTH} AND (SELECT count(DISTINCT x) FROM (SELECT x FROM na WHERE na.a = p.a UNION SELECT x FROM nb WHERE nb.b = p.b)) >= 2")(lambda s, d: _pairs(s, d).where(has_representatives([F.col("x"), F.col("y")])).select("a", "b"))
_query("distinct_pairs", f"{_SETS} SELECT a, b, ((SELECT count(*) FROM na WHERE na.a = p.a) * (SELECT count(*) FROM nb WHERE nb.b = p.b) - {_COMMON})::BIGINT AS n FROM p {_BOTH}")(lambda s, d: _pairs(s, d).select("a", "b", distinct_tuples([F.col("x"), F.col("y")]).alias("n")))
_query("prune_sets", f"{_SETS}, k AS (SELECT p.a, p.b, na.x FROM p JOIN na USING (a) {_BOTH.replace('WHERE a', 'WHERE p.a').replace('AND b', 'AND p.b')}) SELECT a AS k_0, b AS k_1, x AS k_2, ((SELECT count(*) FROM nb WHERE nb.b = k.b) - (SELECT count(*) FROM nb WHERE nb.b = k.b AND nb.x = k.x))::INT AS n FROM k WHERE (SELECT count(*) FROM nb WHERE nb.b = k.b AND nb.x <> k.x) > 0")(
    lambda s, d: X.prune_sets(_pairs(s, d).select(F.col("a").alias("k_0"), F.col("b").alias("k_1"), F.explode("x").alias("k_2"), F.col("y").alias("s_3")), 2, [3]).select("k_0", "k_1", "k_2", F.size("s_3").alias("n"))
)
# expansion operators: rows of the compressed relation, a set as its size --------------------------
_E12, _E13, _E23 = ("SELECT src, dst FROM le WHERE sl = 1 AND dl = 2", "SELECT src, dst FROM le WHERE sl = 1 AND dl = 3", "SELECT src, dst FROM le WHERE sl = 2 AND dl = 3")
_X = f"WITH {_P}, e12 AS MATERIALIZED ({_E12}), e13 AS MATERIALIZED ({_E13}), e23 AS MATERIALIZED ({_E23})"


def _start(s, d):
    return X.root(scan.label_degree_scan(graph(s, d), 1, 1), 0)


def _shown(rel):
    return rel.select(*X.keys_of(rel), *[F.size(c).alias(f"n_{c[2:]}") for c in X.sets_of(rel)])


_query("x_key_key", f"{_X} SELECT src AS k_0, dst AS k_1 FROM e12")(lambda s, d: X.key_to_key(_start(s, d), 0, 1, _of(s, d, 1, 2)))
_query("x_key_set", f"{_X} SELECT src AS k_0, count(*)::INT AS n_1 FROM e12 GROUP BY 1")(lambda s, d: _shown(X.key_to_set(_start(s, d), 0, 1, X.adjacency(_of(s, d, 1, 2)))))
_query("x_keykey_vertex", f"{_X} SELECT e12.src AS k_0, e12.dst AS k_1, e13.dst AS k_2 FROM e12 JOIN e13 USING (src) JOIN e23 ON e23.src = e12.dst AND e23.dst = e13.dst")(
    lambda s, d: X.keys_to_key(X.key_to_key(_start(s, d), 0, 1, _of(s, d, 1, 2)), [0, 1], 2, {0: _of(s, d, 1, 3), 1: _of(s, d, 2, 3)})
)
_query("x_keyset_vertex", f"{_X} SELECT e12.src AS k_0, e12.dst AS k_1, count(*)::INT AS n_2 FROM e12 JOIN e13 USING (src) JOIN e23 ON e23.src = e12.dst AND e23.dst = e13.dst GROUP BY 1, 2")(
    lambda s, d: _shown(X.keys_to_set(X.key_to_key(_start(s, d), 0, 1, _of(s, d, 1, 2)), [0, 1], 2, {0: X.adjacency(_of(s, d, 1, 3)), 1: X.adjacency(_of(s, d, 2, 3))}))
)
_SETKEY = f"{_X} SELECT e12.src AS k_0, e23.dst AS k_2, count(*)::INT AS n_1 FROM e12 JOIN e23 ON e23.src = e12.dst GROUP BY 1, 2"


def _with_set(s, d):
    return X.key_to_set(_start(s, d), 0, 1, X.adjacency(_of(s, d, 1, 2)))


_query("x_set_key_by_parent", _SETKEY)(lambda s, d: _shown(X.set_to_key_by_parent(_with_set(s, d), 1, 2, _of(s, d, 2, 3))))
_query("x_set_key_by_extension", _SETKEY)(lambda s, d: _shown(X.set_to_key_by_extension(_with_set(s, d), 1, 2, _of(s, d, 2, 3), X.adjacency(_of(s, d, 3, 2)))))
_query("x_set_key_by_candidate", _SETKEY)(lambda s, d: _shown(X.set_to_key_by_candidate(_with_set(s, d), 1, 2, X.adjacency(_of(s, d, 3, 2)))))
_query("x_setkey_vertex", f"{_X}, e14 AS (SELECT src, dst FROM le WHERE sl = 1 AND dl = 4), e43 AS (SELECT src, dst FROM le WHERE sl = 4 AND dl = 3), one AS (SELECT e12.src AS k_0, e23.dst AS k_3, count(*)::INT AS n_1 FROM e12 JOIN e23 ON e23.src = e12.dst GROUP BY 1, 2), two AS (SELECT e14.src AS k_0, e43.dst AS k_3, count(*)::INT AS n_2 FROM e14 JOIN e43 ON e43.src = e14.dst GROUP BY 1, 2) SELECT * FROM one JOIN two USING (k_0, k_3)")(
    lambda s, d: _shown(X.sets_to_key(X.key_to_set(_with_set(s, d), 0, 2, X.adjacency(_of(s, d, 1, 4))), [1, 2], 3, _of(s, d, 2, 3), {1: X.adjacency(_of(s, d, 3, 2)), 2: X.adjacency(_of(s, d, 3, 4))}))
)
_query("x_into", f"{_X} SELECT e13.src AS k_0, e13.dst AS k_2, count(*)::INT AS n_1 FROM e13 JOIN e12 USING (src) JOIN e23 ON e23.src = e12.dst AND e23.dst = e13.dst GROUP BY 1, 2")(
    lambda s, d: _shown(X.into(X.key_to_key(_with_set(s, d), 0, 2, _of(s, d, 1, 3)), 2, [1], {1: X.adjacency(_of(s, d, 3, 2))}))
)
_query("x_enum_key_set", f"{_X} SELECT e12.src AS k_0, e12.dst AS k_1, count(*)::INT AS n_2 FROM e12 JOIN e23 ON e23.src = e12.dst GROUP BY 1, 2")(lambda s, d: _shown(X.key_to_set(X.promote(_with_set(s, d), 1), 1, 2, X.adjacency(_of(s, d, 2, 3)))))
# end to end ---------------------------------------------------------------------------------------
for _name, _p in PATTERNS.items():
    for _how in ("none", "static", "eager", "dynamic"):
        _query(f"count_{_name}_{_how}", _count_sql(_p))(lambda s, d, p=_p, c=_how: Query(graph(s, d), p, Config(pruning="nlf", compression=c)).count())
for _kind in ("none", "ldf", "cfl", "daf", "gql", "tso"):
    _query(f"count_diamond_{_kind}_pruning", _count_sql(_PRUNED))(lambda s, d, k=_kind: Query(graph(s, d), _PRUNED, Config(pruning=k)).count())
_query("count_diamond_sample", _count_sql(_PRUNED))(lambda s, d: Query(graph(s, d), _PRUNED, Config(pruning="nlf", compression="sample")).count())
_query("count_limit", _count_sql(PATTERNS["star3_same_label"], limit=100))(lambda s, d: Query(graph(s, d), PATTERNS["star3_same_label"], Config(pruning="nlf", compression="static", limit=100)).count())
_query("enumerate_triangle", f"WITH {_P},\n{_matches_sql(PATTERNS['triangle'])}\nSELECT u0, u1, u2 FROM m2")(lambda s, d: Query(graph(s, d), PATTERNS["triangle"], Config(pruning="nlf")).rows())
_query("enumerate_diamond", f"WITH {_P},\n{_matches_sql(_PRUNED)}\nSELECT u0, u1, u2, u3 FROM m3")(lambda s, d: Query(graph(s, d), _PRUNED, Config(pruning="nlf", compression="static")).rows())
_OPS = Pattern([5, 4, 3], [(0, 1), (0, 2), (1, 2)])
_SAME = Pattern([2, 1, 3], [(0, 1), (1, 2)])
_query("h_order_part_supplier", _count_sql(_OPS, _H))(lambda s, d: Query(graph(s, d, "H"), _OPS, Config(pruning="ldf", compression="static")).count())
_query("h_customer_supplier_same_nation", _count_sql(_SAME, _H))(lambda s, d: Query(graph(s, d, "H"), _SAME, Config(pruning="ldf", compression="dynamic")).count())


# sinks, group operators, larger patterns ------------------------------------------------------------
@_query("written_rows", f"WITH {_P},\n{_matches_sql(PATTERNS['triangle'])}\nSELECT u0, u1, u2 FROM m2")
def written_rows(spark, sf_dir):
    """The triangles, written as files and read again."""
    path = _path(spark, "rows")
    Query(graph(spark, sf_dir), PATTERNS["triangle"], Config(pruning="nlf", compression="static")).write(path)
    return spark.read.parquet(path).select("u0", "u1", "u2")


_STAR = PATTERNS["star3_same_label"]
_STAR_SQL = f"WITH {_P}, m AS (SELECT s.src AS a, (SELECT count(*) FROM le x WHERE x.src = s.src AND x.dl = 1) AS b, (SELECT count(*) FROM le x WHERE x.src = s.src AND x.dl = 3) AS c FROM (SELECT DISTINCT src FROM le WHERE sl = 2) s)"


def _star(s, d):
    g = graph(s, d)
    rel = X.root(scan.label_degree_scan(g, 2, 0), 0)
    for t, label in ((1, 1), (2, 1), (3, 3)):
        rel = X.key_to_set(rel, 0, t, X.adjacency(_of(s, d, 2, label)))
    return rel


_query("product_counts", f"{_STAR_SQL} SELECT a AS k_0, (b * b * c)::BIGINT AS n FROM m WHERE b > 0 AND c > 0")(lambda s, d: _star(s, d).select("k_0", output.product(_star(s, d)).alias("n")))
_query("existing_rows", f"{_STAR_SQL} SELECT a AS k_0 FROM m WHERE b > 1 AND c > 0")(lambda s, d: output.existing(_star(s, d), _STAR).select("k_0"))
_query("set_pruning", f"{_STAR_SQL} SELECT a AS k_0, b::INT AS n FROM m WHERE b > 1 AND c > 0")(lambda s, d: X.set_pruning(_star(s, d), [[1, 2], [3]]).select("k_0", F.size("s_1").alias("n")))
_query("group_text", f"WITH {_P} SELECT '0:' || src || ' 1:{{' || string_agg(dst::VARCHAR, ',' ORDER BY dst) || '}}' AS value FROM le WHERE sl = 1 AND dl = 2 GROUP BY src")(lambda s, d: output.described(_with_set(s, d)))


def _walk_sql(labels: list[int], name: str) -> str:
    """CTEs counting the walks over distinct labels, from each start to each end: {name}(a, b, n)."""
    out = [f"{name}0 AS MATERIALIZED (SELECT src AS a, dst AS b, 1::HUGEINT AS n FROM le WHERE sl = {labels[0]} AND dl = {labels[1]})"]
    for k, (x, y) in enumerate(zip(labels[1:], labels[2:]), 1):
        out.append(f"{name}{k} AS MATERIALIZED (SELECT a, le.dst AS b, sum(n) AS n FROM {name}{k - 1} JOIN le ON le.src = b AND sl = {x} AND dl = {y} GROUP BY ALL)")
    return ",\n".join(out)


_PATH12 = Pattern(range(1, 13), [(k, k + 1) for k in range(11)])
_query("count_path12_dynamic", f"WITH {_P},\n{_walk_sql(list(range(1, 13)), 'w')}\nSELECT sum(n)::BIGINT AS n FROM w10")(lambda s, d: Query(graph(s, d), _PATH12, Config(pruning="ldf")).count())
_TREE16 = Pattern(range(1, 17), [(k, (k - 1) // 2) for k in range(1, 16)])


def _tree_sql(p: Pattern, root: int = 0) -> str:
    """CTEs t{v}(id, n): matches of the subtree under each candidate of v, for trees with distinct labels."""
    order, tree = p.bfs(root)
    out = []
    for v in reversed(order):
        rows = f"(SELECT id, 1::HUGEINT AS n FROM v WHERE label = {p.labels[v]})"
        joins = " ".join(f"JOIN (SELECT le.src AS id, sum(t{c}.n) AS n{c} FROM le JOIN t{c} ON t{c}.id = le.dst WHERE sl = {p.labels[v]} AND dl = {p.labels[c]} GROUP BY 1) x{c} USING (id)" for c in tree[v].children)
        out.append(f"t{v} AS MATERIALIZED (SELECT id, {' * '.join(['n', *(f'n{c}' for c in tree[v].children)])} AS n FROM {rows} {joins})")
    return ",\n".join(out)


_query("count_tree16_gql", f"WITH {_P},\n{_tree_sql(_TREE16)}\nSELECT sum(n)::BIGINT AS n FROM t0")(lambda s, d: Query(graph(s, d), _TREE16, Config(pruning="gql")).count())
_CYCLE10 = Pattern(range(1, 11), [(k, (k + 1) % 10) for k in range(10)])
_query("count_cycle10_dynamic", f"WITH {_P},\n{_walk_sql([1, 2, 3, 4, 5, 6], 'l')},\n{_walk_sql([1, 10, 9, 8, 7, 6], 'r')}\nSELECT sum(l4.n * r4.n)::BIGINT AS n FROM l4 JOIN r4 USING (a, b)")(lambda s, d: Query(graph(s, d), _CYCLE10, Config(pruning="nlf")).count())
_STAR12 = Pattern([1, *[2] * 6, *[3] * 6], [(0, k) for k in range(1, 13)])


def _star_candidates_sql(p: Pattern) -> str:
    """Candidates of a star with two leaf labels after matching filters: the hub needs as many neighbours, a leaf a hub."""
    need = " AND ".join(f"(SELECT count(*) FROM le WHERE le.src = v.id AND le.dl = {label}) >= {n}" for label, n in p.needs(0).items())
    leaves = " UNION ALL ".join(f"SELECT {v}::INT AS qv, id FROM v WHERE label = {p.labels[v]} AND id IN (SELECT dst FROM le WHERE src IN (SELECT id FROM hub))" for v in range(1, p.n))
    return f"WITH {_P}, hub AS MATERIALIZED (SELECT id FROM v WHERE label = {p.labels[0]} AND {need}) SELECT 0::INT AS qv, id FROM hub UNION ALL {leaves}"


_query("cand_gql_star12", _star_candidates_sql(_STAR12))(lambda s, d: Query(graph(s, d), _STAR12, Config(pruning="gql")).candidate_table())


# planning: on the driver, checked by enumeration ----------------------------------------------------
def _pattern_tables() -> str:
    """CTEs pv(pattern, v, label) and pe(pattern, a, b) of all patterns."""
    pv = ", ".join(f"('{name}', {v}, {p.labels[v]})" for name, p in PATTERNS.items() for v in range(p.n))
    pe = ", ".join(f"('{name}', {a}, {b})" for name, p in PATTERNS.items() for a, b in p.edges)
    return f"pv(pattern, v, label) AS MATERIALIZED (VALUES {pv}), pe(pattern, a, b) AS MATERIALIZED (VALUES {pe}), pd AS MATERIALIZED (SELECT pattern, v, label, (SELECT count(*) FROM pe WHERE pe.pattern = pv.pattern AND (a = v OR b = v)) AS deg FROM pv), mask AS MATERIALIZED (SELECT pattern, m FROM (SELECT pattern, count(*) AS n FROM pv GROUP BY 1), range(32) t(m) WHERE m < (1 << n::INT))"


_COVER = "SELECT pattern, m, (SELECT sum({weight}) FROM pv WHERE pv.pattern = mask.pattern AND (m >> v) & 1 = 1) AS w FROM mask WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.pattern = mask.pattern AND (m >> a) & 1 = 0 AND (m >> b) & 1 = 0)"
_BEST_COVERS = "WITH {tables}, c AS MATERIALIZED ({cover}) SELECT pattern, w::DOUBLE AS weight, (SELECT string_agg(v::VARCHAR, ',' ORDER BY v) FROM pv WHERE pv.pattern = c.pattern AND (m >> v) & 1 = 1) AS cover FROM c WHERE w = (SELECT min(w) FROM c d WHERE d.pattern = c.pattern)"


def _covers(spark, weigh):
    rows = []
    for name, p in PATTERNS.items():
        weight, found = minimum_covers(p.n, p.edges, [weigh(label) for label in p.labels])
        rows += [(name, float(weight), ",".join(map(str, sorted(c)))) for c in found]
    return spark.createDataFrame(rows, "pattern string, weight double, cover string")


_query("minimum_covers", _BEST_COVERS.format(tables=_pattern_tables(), cover=_COVER.format(weight="1")))(lambda s, d: _covers(s, lambda label: 1))
_query("minimum_weight_covers", _BEST_COVERS.format(tables=_pattern_tables(), cover=_COVER.format(weight="label + 1")))(lambda s, d: _covers(s, lambda label: label + 1))
_query("pattern_cores", f"WITH {_pattern_tables()}, within AS MATERIALIZED (SELECT mask.pattern, m, v, (SELECT count(*) FROM pe WHERE pe.pattern = mask.pattern AND (a = v AND (m >> b) & 1 = 1 OR b = v AND (m >> a) & 1 = 1)) AS k FROM mask JOIN pv ON pv.pattern = mask.pattern AND (m >> v) & 1 = 1), least_ AS MATERIALIZED (SELECT pattern, m, min(k) AS k FROM within GROUP BY ALL) SELECT w.pattern, w.v::INT AS vertex, max(l.k)::INT AS core FROM within w JOIN least_ l ON l.pattern = w.pattern AND l.m = w.m GROUP BY ALL")(
    lambda s, d: s.createDataFrame([(name, v, k) for name, p in PATTERNS.items() for v, k in enumerate(p.core_numbers())], "pattern string, vertex int, core int")
)
_query("pattern_levels", f"WITH RECURSIVE {_pattern_tables()}, r(pattern, v, l) AS (SELECT pattern, v, 0 FROM pv WHERE v = 0 UNION SELECT r.pattern, CASE WHEN pe.a = r.v THEN pe.b ELSE pe.a END, l + 1 FROM r JOIN pe ON pe.pattern = r.pattern AND (pe.a = r.v OR pe.b = r.v) WHERE l < 5) SELECT pattern, v::INT AS vertex, min(l)::INT AS level FROM r GROUP BY ALL")(
    lambda s, d: s.createDataFrame([(name, v, node.level) for name, p in PATTERNS.items() for v, node in enumerate(p.bfs(0)[1])], "pattern string, vertex int, level int")
)
_CORES = ", ".join(f"('{name}', {v}, {k})" for name, p in PATTERNS.items() for v, k in enumerate(p.core_numbers()))
_START = f"WITH {_P}, {_pattern_tables()}, pc(pattern, v, core) AS (VALUES {_CORES}), freq AS MATERIALIZED (SELECT label, count(*) AS f FROM v GROUP BY 1), size AS MATERIALIZED (SELECT pd.pattern, pd.v, pd.deg, pd.label, pc.core, coalesce(f, 0) AS f, (SELECT count(*) FROM deg WHERE deg.label = pd.label AND deg.degree >= pd.deg) AS n FROM pd JOIN pc USING (pattern, v) LEFT JOIN freq USING (label))"
_THREE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY f / deg, v) AS r FROM {0}) WHERE r <= 3"
_query(
    "start_vertices",
    f"""{_START}, core AS (SELECT * FROM size s WHERE core > 1 OR NOT EXISTS (SELECT 1 FROM size t WHERE t.pattern = s.pattern AND t.core > 1)),
dense AS (SELECT * FROM size s WHERE deg > 1 OR NOT EXISTS (SELECT 1 FROM size t WHERE t.pattern = s.pattern AND t.deg > 1)),
three AS ({_THREE.format('core')}), any3 AS ({_THREE.format('size')}),
rare AS (SELECT * FROM any3 s WHERE f <= 0.05 * (SELECT count(*) FROM v) OR NOT EXISTS (SELECT 1 FROM any3 t WHERE t.pattern = s.pattern AND t.f <= 0.05 * (SELECT count(*) FROM v)))
SELECT pattern, 'core' AS kind, arg_min(v, (n / deg, v))::INT AS vertex FROM three GROUP BY 1
UNION ALL SELECT pattern, 'dense', arg_min(v, (n / deg, v))::INT FROM dense GROUP BY 1 UNION ALL SELECT pattern, 'rare', arg_min(v, (n, v))::INT FROM rare GROUP BY 1""",
)(lambda s, d: _starts(s, d))


def _starts(spark, sf_dir):
    """The vertex that each kind of filter sequence starts at, by candidates and label frequencies."""
    g = graph(spark, sf_dir)
    freq, rows = g.frequencies, []
    for name, p in PATTERNS.items():
        sizes = Query(g, p, Config(pruning="ldf")).sizes
        rows += [(name, "core", orders.core_start(p, sizes, freq)), (name, "dense", orders.dense_start(p, sizes)), (name, "rare", orders.rare_start(p, sizes, freq, sum(freq.values())))]
    return spark.createDataFrame(rows, "pattern string, kind string, vertex int")


_query(
    "matching_order_by_size",
    f"""{_START.replace('WITH ', 'WITH RECURSIVE ', 1)}, r(pattern, k, seen) AS (SELECT pattern, 1, [arg_min(v, (n / deg, v))] FROM size GROUP BY 1
UNION ALL SELECT r.pattern, any_value(k) + 1, list_append(any_value(seen), arg_min(v, ((core <= 1)::INT, n, v))) FROM r JOIN size s ON s.pattern = r.pattern
WHERE NOT list_contains(seen, v) AND EXISTS (SELECT 1 FROM pe WHERE pe.pattern = r.pattern AND (a = v AND list_contains(seen, b) OR b = v AND list_contains(seen, a))) GROUP BY r.pattern)
SELECT pattern, array_to_string(arg_max(seen, k), ' ') AS matching_order FROM r GROUP BY 1""",
)(lambda s, d: s.createDataFrame([(name, " ".join(map(str, orders.matching_order(p, Query(graph(s, d), p, Config(pruning="ldf")).sizes)))) for name, p in PATTERNS.items()], "pattern string, matching_order string"))
_query(
    "static_covers",
    f"""{_START}, c AS MATERIALIZED (SELECT pattern, m, (SELECT round(sum(log2(greatest(2, n))), 9) FROM size WHERE size.pattern = mask.pattern AND (m >> v) & 1 = 1) AS w, (SELECT list(v ORDER BY v) FROM pv WHERE pv.pattern = mask.pattern AND (m >> v) & 1 = 1) AS vs
FROM mask WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.pattern = mask.pattern AND (m >> a) & 1 = 0 AND (m >> b) & 1 = 0))
SELECT pattern, array_to_string(arg_min(vs, (w, len(vs), vs)), ',') AS cover FROM c GROUP BY 1""",
)(lambda s, d: s.createDataFrame([(name, ",".join(map(str, sorted(planner.smallest(planner.covers(p, Query(graph(s, d), p, Config(pruning="ldf")).sizes)))))) for name, p in PATTERNS.items()], "pattern string, cover string"))
_LINES = "t 5 6\nv 10 1 2\nv 11 2 3\nv 12 3 3\nv 13 3 2\nv 14 9 2\ne 10 11\ne 10 12\ne 10 13\ne 11 12\ne 11 13\ne 13 14"
_query("count_induced_pattern", _count_sql(PATTERNS["diamond"]))(lambda s, d: Query(graph(s, d), text.read_pattern(_LINES).induced([0, 1, 2, 3]), Config(pruning="nlf")).count())
_query("settings", "SELECT * FROM (VALUES ('cps=gql, mo=2 0 1, cs=eager, limit=25', 'gql', 'eager', '2 0 1', 25::BIGINT), ('limit=0', 'cfl', 'dynamic', '', NULL), ('compression_strategy=none', 'cfl', 'none', '', NULL)) t(given, pruning, compression, matching_order, match_limit)")(
    lambda s, d: s.createDataFrame([(x, c.pruning, c.compression, " ".join(map(str, c.order or [])), c.limit) for x in ("cps=gql, mo=2 0 1, cs=eager, limit=25", "limit=0", "compression_strategy=none") for c in [Config.parse(x)]], "given string, pruning string, compression string, matching_order string, match_limit bigint")
)
_PROFILED = " UNION ALL ".join(f"SELECT {k}::INT AS step, (SELECT count(*) FROM m{k})::BIGINT AS out_subgraphs" for k in range(4))
_query("profile_counts", f"WITH {_P},\n{_matches_sql(_PRUNED)}\n{_PROFILED}")(
    lambda s, d: s.createDataFrame([(r["step"], r["out_subgraphs"]) for r in Query(graph(s, d), _PRUNED, Config(pruning="none", compression="static", order=[0, 1, 2, 3])).profile()], "step int, out_subgraphs bigint")
)


@_query("matching_orders")
def matching_orders(spark, sf_dir):
    """Matching order and plan of every pattern."""
    g = graph(spark, sf_dir)
    found = [(name, Query(g, p, Config(pruning="ldf"))) for name, p in PATTERNS.items()]
    return spark.createDataFrame([(name, " ".join(map(str, q.plan.order)), q.explain()) for name, q in found], "pattern string, matching_order string, plan string")


@_query("plan_covers")
def plan_covers(spark, sf_dir):
    """Keys by level and cost of each compression strategy, for every pattern."""
    rows = []
    for name, p in PATTERNS.items():
        q = Query(graph(spark, sf_dir), p, Config(pruning="ldf"))
        for a in planner.analyse(p, q.plan.order, q.sizes):
            rows.append((name, a["strategy"], str(a["keys"]), float(a["cost"])))
    return spark.createDataFrame(rows, "pattern string, strategy string, keys string, cost double")


@_query("profile_steps")
def profile_steps(spark, sf_dir):
    """Counters of each step of the diamond."""
    rows = Query(graph(spark, sf_dir), _PRUNED, Config(pruning="nlf", compression="static")).profile()
    return spark.createDataFrame(rows, "step int, operator string, vertex int, ms bigint, in_groups bigint, out_groups bigint, in_subgraphs bigint, out_subgraphs bigint, set_members bigint, intersections bigint")


def queries() -> dict:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
