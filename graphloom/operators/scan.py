"""Candidates of each pattern vertex by label, degree and the labels and degrees of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import LabeledGraph
from graphloom.plans.pattern import Pattern


def degree_scan(graph: LabeledGraph, degree: int) -> DataFrame:
    return graph.vertices.where(F.col("degree") >= degree).select("id")


def label_degree_scan(graph: LabeledGraph, label: int, degree: int) -> DataFrame:
    return graph.vertices.where((F.col("label") == label) & (F.col("degree") >= degree)).select("id")


def label_degree(graph: LabeledGraph, p: Pattern) -> DataFrame:
    """(qv, id) for all pattern vertices in one pass; the pattern's rows (under 64) are broadcast."""
    rows = graph.spark.createDataFrame([(v, p.labels[v], p.degree(v)) for v in range(p.n)], "qv int, label int, need int")
    return graph.vertices.join(F.broadcast(rows), "label").where("degree >= need").select("qv", "id")


def neighbour_labels(graph: LabeledGraph, p: Pattern, largest_degree: bool = False) -> DataFrame:
    """(qv, id) that have, label by label, as many neighbours as the pattern vertex; optionally also a neighbour of as high a degree."""
    cand = label_degree(graph, p)
    needs = [(v, p.labels[v], label, n) for v in range(p.n) for label, n in p.needs(v).items()]
    if needs:
        rows = graph.spark.createDataFrame(needs, "qv int, src_label int, nlabel int, need int")
        labels = sorted({(x[1], x[2]) for x in needs})
        pairs = F.struct("src_label", "nlabel").isin([F.struct(F.lit(a), F.lit(b)) for a, b in labels]) if len(labels) < 200 else F.lit(True)
        met = graph.neighbour_labels.where(pairs).join(F.broadcast(rows), ["src_label", "nlabel"]).where("n >= need").groupBy("qv", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("met"))
        wanted = graph.spark.createDataFrame([(v, len(p.needs(v))) for v in range(p.n)], "qv int, wanted int")
        free = wanted.where("wanted = 0")
        ok = met.join(F.broadcast(wanted), "qv").where("met = wanted").select("qv", "id")
        cand = cand.join(ok, ["qv", "id"], "left_semi").union(cand.join(F.broadcast(free), "qv", "left_semi"))
    if largest_degree:
        most = [(v, max((p.degree(w) for w in p.adj[v]), default=0)) for v in range(p.n)]
        rows = graph.spark.createDataFrame(most, "qv int, most int")
        cand = cand.join(F.broadcast(rows), "qv").join(graph.neighbour_degree.withColumnRenamed("src", "id"), "id", "left").where("most = 0 or mnd >= most").select("qv", "id")
    return cand
