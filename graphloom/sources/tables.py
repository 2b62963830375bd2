"""Graphs derived from relational tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import LabeledGraph

#: Ids of the entity graph are label * SPAN + key.
SPAN = 1_000_000_000_000


def copurchase(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """Parts, labelled by brand number; an edge joins two parts of one order."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("label"))
    # labels go along, so that the pairs need not be joined with the parts again
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("bigint").alias("id")).distinct()
    x = line.join(part.withColumn("id", F.col("id").cast("bigint")), "id")
    pairs = x.toDF("src", "o", "src_label").join(x.toDF("dst", "o", "dst_label"), "o").where("src < dst").select("src", "dst", "src_label", "dst_label").distinct()
    return LabeledGraph.from_labelled(part.withColumn("id", F.col("id").cast("bigint")), pairs)


def entities(spark: SparkSession, sf_dir: str) -> LabeledGraph:
    """Regions, nations, customers, suppliers, parts and orders (labels 0 to 5), joined by their keys."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    at = lambda label, key: (F.lit(label * SPAN) + F.col(key).cast("bigint"))
    tables = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")]
    vertices = reduce(DataFrame.union, [read(t).select(at(k, key).alias("id"), F.lit(k).alias("label")) for k, (t, key) in enumerate(tables)])
    line = read("lineitem")
    links = [
        (read("nation"), at(1, "n_nationkey"), at(0, "n_regionkey")), (read("customer"), at(2, "c_custkey"), at(1, "c_nationkey")), (read("supplier"), at(3, "s_suppkey"), at(1, "s_nationkey")),
        (read("orders"), at(5, "o_orderkey"), at(2, "o_custkey")), (line, at(5, "l_orderkey"), at(4, "l_partkey")), (line, at(5, "l_orderkey"), at(3, "l_suppkey")), (line, at(4, "l_partkey"), at(3, "l_suppkey")),
    ]
    return LabeledGraph.from_tables(vertices, reduce(DataFrame.union, [t.select(a.alias("src"), b.alias("dst")) for t, a, b in links]))


_loaded: dict = {}


def graph(spark: SparkSession, sf_dir: str, name: str = "P") -> LabeledGraph:
    """The derived graph, persisted once per session and folder until ``forget``."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _loaded:
        _loaded[key] = {"P": copurchase, "H": entities}[name](spark, sf_dir).persist()
    return _loaded[key]


def forget(spark: SparkSession) -> None:
    """Drop the session's derived graphs from memory."""
    for key in [k for k in _loaded if k[0] == spark.sparkContext.applicationId]:
        _loaded.pop(key).unpersist()
