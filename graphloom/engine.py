"""Counting and listing the embeddings of a pattern in a labelled graph."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import LabeledGraph
from graphloom.operators import expand as X
from graphloom.operators import filters, output, scan
from graphloom.plans import cover, planner, pruning
from graphloom.plans import order as orders
from graphloom.plans.pattern import Pattern
from graphloom.work import discard, settle

PRUNING = ("none", "ldf", "nlf", "cfl", "daf", "gql", "tso")
#: Neighbours of one label from which sets are dealt over parts, about as many members to a part.
SET_SIZE = 1_000_000
#: Shares of the root's candidates, of 64, that a count with a limit looks at one after another.
SHARES = (1, 8, 64)


@dataclass
class Config:
    pruning: str = "cfl"
    compression: str = "dynamic"
    order: list[int] | None = None
    limit: int | None = None
    #: Vertex to start filter sequences at; chosen from candidates if None.
    root: int | None = None

    @classmethod
    def parse(cls, text: str) -> "Config":
        """Settings as name=value, comma-separated, by short or long names: ``cps=gql, mo=2 0 1, cs=eager, limit=25``; limit 0 is none."""
        out = cls()
        for part in filter(None, (x.strip() for x in text.split(","))):
            name, eq, value = part.partition("=")
            if not eq:
                raise ValueError(f"{part!r} is no name=value")
            name, value = name.strip(), value.strip()
            if name in ("cps", "candidate_pruning_strategy"):
                out.pruning = value
            elif name in ("cs", "compression_strategy"):
                out.compression = value
            elif name in ("mo", "matching_order"):
                out.order = [int(x) for x in value.split()]
            elif name == "limit":
                out.limit = int(value) or None
            else:
                raise ValueError(f"unknown setting {name!r}")
        return out.checked()

    def checked(self) -> "Config":
        if self.pruning not in PRUNING:
            raise ValueError(f"unknown pruning {self.pruning!r}; one of {', '.join(PRUNING)}")
        if self.compression not in planner.STRATEGIES:
            raise ValueError(f"unknown compression {self.compression!r}; one of {', '.join(planner.STRATEGIES)}")
        return self


class Query:
    """A pattern over a graph: candidates, plan, and the relation that the plan makes."""

    def __init__(self, graph: LabeledGraph, pattern: Pattern, config: Config | str | None = None):
        if not pattern.connected():
            raise ValueError("the pattern is not connected")
        self.graph, self.p = graph, pattern
        self.config = Config.parse(config) if isinstance(config, str) else (config or Config()).checked()
        self._cand: dict[int, DataFrame] | None = None
        self._sizes: list[int] | None = None
        self._plan: planner.Plan | None = None
        #: Vertices that are to be keys from their level on.
        self._forced: list[int] = []
        self._edges: dict[tuple[int, int], DataFrame] = {}
        self._adjacent: dict[tuple[int, int], DataFrame] = {}

    # candidates -----------------------------------------------------------------------------------

    def _count(self, table: DataFrame) -> list[int]:
        n = {r["qv"]: r["n"] for r in table.groupBy("qv").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [n.get(v, 0) for v in range(self.p.n)]

    def _sequence(self, sizes: list[int]) -> pruning.Sequence:
        kind, p, freq, root = self.config.pruning, self.p, self.graph.frequencies, self.config.root
        if kind == "cfl":
            return pruning.levels_sequence(p, orders.core_start(p, sizes, freq) if root is None else root)
        if kind == "daf":
            return pruning.sweeps_sequence(p, orders.dense_start(p, sizes) if root is None else root)
        if kind == "tso":
            return pruning.tree_sequence(p, orders.rare_start(p, sizes, freq, sum(freq.values())) if root is None else root)
        return pruning.matching_sequence(p) if kind == "gql" else []

    @property
    def candidates(self) -> dict[int, DataFrame]:
        """Candidates (id) of each pattern vertex, after all filters of the strategy."""
        if self._cand is None:
            g, p, kind = self.graph, self.p, self.config.pruning
            if kind == "none":
                first = scan.label_degree(g, Pattern(p.labels, []))
            elif kind in ("ldf", "daf"):
                first = scan.label_degree(g, p)
            else:
                first = scan.neighbour_labels(g, p, largest_degree=kind == "cfl")
            first = settle(first)
            self._sizes = self._count(first)
            cand = {v: first.where(F.col("qv") == v).select("id") for v in range(p.n)}
            sequence = self._sequence(self._sizes)
            made, steps = [first], [0] * p.n
            for v, pivots in sequence:
                cand[v] = filters.matching(g, p, cand, v) if pivots is None else filters.neighbourhood(g, p, cand, v, pivots)
                steps[v] = 1 + max([steps[v], *(steps[w] for w in (p.adj[v] if pivots is None else pivots))])
                if pivots is None or steps[v] > 1:
                    # written out, as later filters read it several times: plans would grow with their product
                    cand[v], steps[v] = settle(cand[v]), 0
                    made.append(cand[v])
            if sequence:
                table = settle(self._table(cand))
                self._sizes = self._count(table)
                cand = {v: table.where(F.col("qv") == v).select("id") for v in range(p.n)}
                for old in made:
                    discard(old)
            self._cand = cand
        return self._cand

    @staticmethod
    def _table(cand: dict[int, DataFrame]) -> DataFrame:
        out = None
        for v, c in cand.items():
            part = c.select(F.lit(v).alias("qv"), "id")
            out = part if out is None else out.union(part)
        return out

    @property
    def sizes(self) -> list[int]:
        _ = self.candidates
        return self._sizes

    def candidate_table(self) -> DataFrame:
        """(qv, id) of all candidates."""
        return self._table(self.candidates)

    # plan -----------------------------------------------------------------------------------------

    @cached_property
    def parts(self) -> int:
        """Parts that sets are dealt over: by the most neighbours of one label, over the label pairs of the pattern's edges."""
        pairs = {(self.p.labels[a], self.p.labels[b]) for a, b in self.p.edges} | {(self.p.labels[b], self.p.labels[a]) for a, b in self.p.edges}
        wanted = F.struct("src_label", "nlabel").isin([F.struct(F.lit(a), F.lit(b)) for a, b in sorted(pairs)])
        most = self.graph.neighbour_labels.where(wanted).agg(F.max("n")).first()[0] or 0
        return -(-most // SET_SIZE) or 1

    @property
    def plan(self) -> planner.Plan:
        if self._plan is None:
            p, sizes, kind = self.p, self.sizes, self.config.compression
            among = None if kind == "none" or not p.edges else planner.smallest(planner.covers(p, sizes))
            order = orders.checked_order(p, self.config.order) if self.config.order else orders.matching_order(p, sizes, among)
            if kind == "sample":
                sizes = self._sampled(order)
            self._plan = planner.plan(p, order, sizes, kind, self._forced)
        return self._plan

    def _sampled(self, order: list[int], seeds: int = 5000) -> list[int]:
        """Distinct values seen for each vertex when a sample of at most ``seeds`` rows a level is expanded."""
        made, out = planner.plan(self.p, order, self.sizes, "none"), list(self.sizes)
        rel = X.root(self.candidates[order[0]], order[0])
        for step in made.steps:
            rel = self._apply(rel, step) if step.key_parents else rel
            rel = self.graph.spark.createDataFrame(rel.orderBy(F.xxhash64(*rel.columns)).limit(seeds).toArrow(), schema=rel.schema)
            out[step.vertex] = max(1, rel.select(X.key(step.vertex)).distinct().count())
        return out

    def explain(self) -> str:
        sizes = " ".join(map(str, self.sizes))
        return f"pruning {self.config.pruning}, candidates {sizes}; compression {self.config.compression}\n{self.plan.explain()}"

    # execution ------------------------------------------------------------------------------------

    def edges(self, a: int, b: int) -> DataFrame:
        if (a, b) not in self._edges:
            of = self.graph.edges.where((F.col("src_label") == self.p.labels[a]) & (F.col("dst_label") == self.p.labels[b])).select("src", "dst")
            # where no filter has taken a vertex of the label away, the label says it all
            some = [self.candidates[v] if self.sizes[v] < self.graph.frequencies.get(self.p.labels[v], 0) else None for v in (a, b)]
            self._edges[a, b] = X.candidate_edges(of, *some)
        return self._edges[a, b]

    def adjacent(self, a: int, b: int) -> DataFrame:
        if (a, b) not in self._adjacent:
            self._adjacent[a, b] = X.adjacency(self.edges(a, b), self.parts)
        return self._adjacent[a, b]

    def _apply(self, rel: DataFrame, step: planner.Step) -> DataFrame:
        label = self.p.labels
        same = lambda v, r: [int(c[2:]) for c in X.keys_of(r) if label[int(c[2:])] == label[v] and int(c[2:]) != v]
        sets = lambda v, r: [int(c[2:]) for c in X.sets_of(r) if label[int(c[2:])] == label[v] and int(c[2:]) != v]
        for v in step.promote:
            rel = X.promote(rel, v, same(v, rel))
            rel = X.prune_sets(rel, v, sets(v, rel))
        t, kp, sp = step.vertex, step.key_parents, step.set_parents
        if step.kind == "set":
            rel = X.keys_to_set(rel, kp, t, {p: self.adjacent(p, t) for p in kp}, same(t, rel))
            return X.set_pruning(rel, [[t, *sets(t, rel)]])
        if kp:
            first = sorted(kp, key=lambda p: self.sizes[p], reverse=True)
            rel = X.keys_to_key(rel, first, t, {p: self.edges(p, t) for p in kp}, same(t, rel))
            rel = X.into(rel, t, sp, {p: self.adjacent(t, p) for p in sp}) if sp else rel
        elif len(sp) == 1 and step.how == "candidate":
            rel = X.set_to_key_by_candidate(rel, sp[0], t, self.adjacent(t, sp[0]), same(t, rel))
        elif len(sp) == 1 and step.how == "parent":
            rel = X.set_to_key_by_parent(rel, sp[0], t, self.edges(sp[0], t), same(t, rel), self.parts)
        else:
            cheap = sorted(sp, key=lambda p: self.sizes[p])
            rel = X.sets_to_key(rel, cheap, t, self.edges(cheap[0], t), {p: self.adjacent(t, p) for p in sp}, same(t, rel))
        rel = X.prune_sets(rel, t, sets(t, rel))
        shrunk = {label[v] for v in [t, *sp]}
        return X.set_pruning(rel, [[v for v in map(int, (c[2:] for c in X.sets_of(rel))) if label[v] == x] for x in sorted(shrunk)])

    @property
    def relation(self) -> DataFrame:
        """The compressed matches."""
        return self._relation(None)

    def _relation(self, share: int | None) -> DataFrame:
        """The compressed matches, of all or of some 64ths of the root's candidates."""
        cand = self.candidates[self.plan.order[0]]
        rel = X.root(cand if share is None else cand.where(F.pmod(F.xxhash64("id"), F.lit(64)) < share), self.plan.order[0])
        for step in self.plan.steps[1:]:
            rel = self._apply(rel, step)
        return rel

    def _walked(self, x: int, run: list[int], y: int, linked, weights: dict[int, DataFrame], beside: DataFrame | None) -> DataFrame:
        """(src, dst, w): the ways from each x to each y through the run's vertices, summed up at every step; ``beside`` holds pairs that x and y have to be."""
        walks, to = linked(x, run[0]), run[0]
        for t in [*run[1:], y]:
            if to in weights:
                walks = walks.join(weights.pop(to).toDF("dst", "more"), "dst").select("src", "dst", (F.col("w") * F.col("more")).alias("w"))
            met = walks.toDF("src", "x", "w").join(linked(to, t).toDF("x", "dst", "v"), "x").where("src <> dst").select("src", "dst", (F.col("w") * F.col("v")).alias("w"))
            if t == y and beside is not None:
                met = met.join(beside.toDF("src", "dst", "v"), ["src", "dst"]).select("src", "dst", (F.col("w") * F.col("v")).alias("w"))
            walks, to = met.groupBy("src", "dst").agg(F.sum("w").alias("w")), t
        return walks

    def folded(self) -> tuple["Query", dict[int, DataFrame], dict[tuple[int, int], DataFrame]] | None:
        """The pattern without its hanging trees and long runs, the weights (id, w) and the weighted pairs (src, dst, w) that these leave; None if there is neither.

        A vertex with one neighbour whose label no other vertex has never collides with any: its matches are summed up
        under the neighbour's, from the tips inwards, and need not be listed. Nor need those of a run of such vertices with two
        neighbours each: it becomes a weighted pair of its ends. A cycle is two runs that meet halfway.
        """
        p = self.p
        live, weights = set(range(p.n)), {}
        near = {v: set(p.adj[v]) for v in live}
        pairs: dict[tuple[int, int], DataFrame] = {}
        alone = {v for v in live if p.labels.count(p.labels[v]) == 1}

        def linked(a: int, b: int) -> DataFrame:
            if (a, b) in pairs:
                return pairs[a, b]
            if (b, a) in pairs:
                return pairs[b, a].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
            return self.edges(a, b).withColumn("w", F.lit(1).cast("bigint"))

        while len(live) > 1:
            tips = [v for v in sorted(live) if len(near[v]) == 1 and v in alone]
            if tips:
                t = tips[-1]
                (u,) = near[t]
                edges, w = linked(u, t), F.col("w")
                if t in weights:
                    edges, w = edges.join(weights[t].toDF("dst", "more"), "dst"), F.col("w") * F.col("more")
                new = edges.groupBy(F.col("src").alias("id")).agg(F.sum(w).alias("w"))
                weights[u] = weights[u].join(new.toDF("id", "more"), "id").select("id", (F.col("w") * F.col("more")).alias("w")) if u in weights else new
                live.discard(t)
                near[u].discard(t)
                weights.pop(t, None)
                pairs = {ends: table for ends, table in pairs.items() if t not in ends}
                continue
            found = cover.long_run({v: near[v] for v in live}, alone.difference(*pairs), self.sizes)
            if found is None:
                break
            x, run, y = found
            beside = linked(x, y) if y in near[x] else None
            made = settle(self._walked(x, run, y, linked, weights, beside))
            for t in run:
                for other in near[t]:
                    near[other].discard(t)
            live -= set(run)
            near[x].add(y)
            near[y].add(x)
            pairs.pop((y, x), None)
            pairs[x, y] = made
        if len(live) == p.n:
            return None
        kept = sorted(live, key=lambda v: (v not in weights, v))
        place = {v: k for k, v in enumerate(kept)}
        order = [place[v] for v in self.config.order if v in place] if self.config.order else None
        left = Pattern([p.labels[v] for v in kept], [(place[a], place[b]) for a in kept for b in near[a]])
        try:
            order = order and orders.checked_order(left, order)
        except ValueError:
            order = None
        rest = Query(self.graph, left, Config(self.config.pruning, self.config.compression, order))
        settled = {place[v]: settle(w) for v, w in weights.items()}
        # a match needs one of every hanging tree, so the weights' ids are the candidates
        rest._cand = {place[v]: settled[place[v]].select("id") if place[v] in settled else self.candidates[v] for v in kept}
        rest._sizes = [rest._cand[k].count() if k in settled else self.sizes[kept[k]] for k in range(len(kept))]
        met = {(place[a], place[b]): table for (a, b), table in pairs.items()}
        for (a, b), table in met.items():
            rest._edges[a, b] = table.select("src", "dst")
            rest._edges[b, a] = table.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        rest._forced = sorted({*settled, *(v for ends in met for v in ends)})
        return rest, settled, met

    def count(self) -> DataFrame:
        """One row ``n``. With a limit, a growing share of the root's candidates is looked at until there are enough."""
        zero = self.graph.spark.createDataFrame([(0,)], "n bigint")
        if not all(self.sizes):
            return zero
        if not self.config.limit:
            rest = self.folded() if self.config.compression != "none" else None
            if rest is None:
                return output.count(self.relation, self.p)
            q, weights, pairs = rest
            return output.count(q.relation, q.p, weights=weights, pairs=pairs) if all(q.sizes) else zero
        for share in SHARES:
            found = output.count(self._relation(None if share == 64 else share), self.p, self.config.limit)
            if share < 64:
                n = found.first()["n"]
                if n >= self.config.limit:
                    return self.graph.spark.createDataFrame([(n,)], "n bigint")
        return found

    def rows(self) -> DataFrame:
        """One row per embedding, u0, u1, ... ; without an order, a limit takes any."""
        if not all(self.sizes):
            return self.graph.spark.createDataFrame([], ", ".join(f"u{v} bigint" for v in range(self.p.n)))
        return output.rows(self.relation, self.p, self.plan.order, self.config.limit)

    def write(self, path: str, kind: str = "parquet") -> None:
        """The embeddings as files, one set for each task."""
        self.rows().write.format(kind).save(path)

    def profile(self) -> list[dict]:
        """For each step: operator, milliseconds, rows, embeddings of the prefix before and after, set intersections made for them."""
        out, before, n_before, last = [], 0, 0, None
        rel = X.root(self.candidates[self.plan.order[0]], self.plan.order[0])
        for k, step in enumerate(self.plan.steps):
            began = time.monotonic()
            rel = (self._apply(rel, step) if k else rel).persist()
            groups = rel.count()
            ms = int(1000 * (time.monotonic() - began))
            if last is not None:
                last.unpersist()
            some = output.limit_sets(rel, self.p)
            n = some.agg(F.coalesce(F.sum(output.per_row(some, self.p)), F.lit(0)).cast("bigint")).first()[0]
            sizes = [F.coalesce(F.sum(F.size(c)), F.lit(0)) for c in X.sets_of(rel)]
            held = rel.agg(*sizes).first() if sizes else []
            each = max(0, len(step.key_parents) - 1) + (len(step.set_parents) if step.kind == "key" and step.how != "parent" else 0)
            out.append({"step": k, "operator": step.operator, "vertex": step.vertex, "ms": ms, "in_groups": before, "out_groups": groups, "in_subgraphs": n_before, "out_subgraphs": n, "set_members": int(sum(held)), "intersections": before * each})
            before, n_before, last = groups, n, rel
        last.unpersist()
        return out


def count(graph: LabeledGraph, pattern: Pattern, config: Config | str | None = None) -> int:
    return Query(graph, pattern, config).count().first()["n"]
