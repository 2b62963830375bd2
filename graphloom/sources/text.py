"""Graphs as text (t/v/e lines) and as Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.graph import LabeledGraph
from graphloom.plans.pattern import Pattern


def read_text(spark: SparkSession, path: str, validate: bool = True) -> LabeledGraph:
    """``t n m``, then ``v id label degree`` and ``e src dst [x]`` lines, in any order; counts are checked against the header."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    vertices = lines.where(F.col("f")[0] == "v").select(F.col("f")[1].cast("bigint").alias("id"), F.col("f")[2].cast("int").alias("label"))
    pairs = lines.where(F.col("f")[0] == "e").select(F.col("f")[1].cast("bigint").alias("src"), F.col("f")[2].cast("bigint").alias("dst"))
    if validate:
        head = lines.where(F.col("f")[0] == "t").select(F.col("f")[1].cast("bigint").alias("n"), F.col("f")[2].cast("bigint").alias("m")).first()
        if head is None:
            raise ValueError(f"{path}: no header line")
        found = lines.groupBy(F.col("f")[0].alias("k")).count().where("k in ('v', 'e')").collect()
        n = {r["k"]: r["count"] for r in found}
        if (n.get("v", 0), n.get("e", 0)) != (head["n"], head["m"]):
            raise ValueError(f"{path}: header says {head['n']} vertices and {head['m']} edges, found {n.get('v', 0)} and {n.get('e', 0)}")
    return LabeledGraph.from_tables(vertices, pairs)


def write_text(graph: LabeledGraph, path: str) -> None:
    """Each edge once, smaller id first; vertices and edges in order of their ids, in one sorted set of files."""
    size = graph.vertices.agg(F.count(F.lit(1)).alias("n")).crossJoin(graph.edges.agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)).alias("m")))
    zero = F.lit(0).cast("bigint")
    head = size.select(F.lit(0).alias("o"), zero.alias("a"), zero.alias("b"), F.concat_ws(" ", F.lit("t"), "n", F.coalesce("m", zero)).alias("value"))
    v = graph.vertices.select(F.lit(1), "id", zero, F.concat_ws(" ", F.lit("v"), "id", "label", "degree"))
    e = graph.edges.where("src < dst").select(F.lit(2), "src", "dst", F.concat_ws(" ", F.lit("e"), "src", "dst"))
    head.union(v).union(e).orderBy("o", "a", "b").select("value").write.text(path)


def read_pattern(text: str) -> Pattern:
    """A pattern from the same lines; the i-th vertex listed becomes vertex i."""
    names: dict[int, int] = {}
    labels, edges = [], []
    for fields in (line.split() for line in text.splitlines() if line.strip()):
        if fields[0] == "v":
            names[int(fields[1])] = len(labels)
            labels.append(int(fields[2]))
        elif fields[0] == "e":
            edges.append((names[int(fields[1])], names[int(fields[2])]))
    return Pattern(labels, edges)


def save(graph: LabeledGraph, path: str) -> None:
    """Parquet, both tables clustered by label so that label filters skip row groups."""
    graph.vertices.repartitionByRange("label", "id").sortWithinPartitions("label", "id").write.parquet(f"{path}/vertices")
    graph.edges.repartitionByRange("src_label", "dst_label", "src").sortWithinPartitions("src_label", "dst_label", "src").write.parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> LabeledGraph:
    return LabeledGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def convert(spark: SparkSession, path: str, out: str, parts: int | None = None, by_degree: bool = True, rounds: int = 2) -> None:
    """Text to Parquet. With ``parts``, vertices are also dealt over so many parts, a folder each, by label and falling degree."""
    graph = read_text(spark, path)
    save(graph, out)
    if parts:
        graph.partitioned(parts, by_degree, rounds).write.partitionBy("part").parquet(f"{out}/parts")
