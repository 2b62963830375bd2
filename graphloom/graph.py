"""The data graph: labelled, undirected, simple; two tables and what is derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.work import settle


class LabeledGraph:
    """``vertices(id, label, degree)`` and ``edges(src, dst, src_label, dst_label)``, each edge in both directions."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges, self._kept = vertices, edges, False

    @classmethod
    def from_tables(cls, vertices: DataFrame, pairs: DataFrame) -> "LabeledGraph":
        """From (id, label) and (src, dst) in any direction; loops, repeats and edges to unknown ids are dropped."""
        v = vertices.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label"))
        p = pairs.select(F.least("src", "dst").cast("bigint").alias("src"), F.greatest("src", "dst").cast("bigint").alias("dst")).where("src < dst").distinct()
        labelled = p.join(v.toDF("src", "src_label"), "src").join(v.toDF("dst", "dst_label"), "dst")
        return cls.from_labelled(v, labelled)

    @classmethod
    def from_labelled(cls, vertices: DataFrame, pairs: DataFrame) -> "LabeledGraph":
        """From (id, label) and each edge once, in either direction, with its ends' labels: (src, dst, src_label, dst_label)."""
        there = F.struct("src", "dst", "src_label", "dst_label")
        back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))
        edges = pairs.select(F.inline(F.array(there, back)))
        degree = edges.groupBy("src").agg(F.count(F.lit(1)).cast("int").alias("degree"))
        held = vertices.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
        return cls(held, edges)

    def persist(self) -> "LabeledGraph":
        """Keep both tables and, once they are asked for, the neighbours' labels and degrees. Edges are not dealt by ``src``: a hub's would be one block."""
        self.edges.persist()
        self.vertices.persist()
        self._kept = True
        return self

    def unpersist(self) -> "LabeledGraph":
        for table in (self.vertices, self.edges, *(self.__dict__.get(x) for x in ("neighbour_labels", "neighbour_degree"))):
            if table is not None:
                table.unpersist()
        return self

    @property
    def spark(self):
        return self.vertices.sparkSession

    @cached_property
    def label_freq(self) -> DataFrame:
        return self.vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def frequencies(self) -> dict[int, int]:
        """Label frequencies on the driver; one row per label."""
        return {r["label"]: r["n"] for r in self.label_freq.collect()}

    @cached_property
    def adjacency(self) -> DataFrame:
        """(src, src_label, nlabel, nbrs ascending, n): neighbours in slices by label."""
        return self.edges.groupBy("src", "src_label", F.col("dst_label").alias("nlabel")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"), F.count(F.lit(1)).alias("n"))

    def neighbours(self, label: int) -> DataFrame:
        """(src, dst) of the neighbours with one label: a filter that reaches the scan, not a slice of a list."""
        return self.edges.where(F.col("dst_label") == label).select("src", "dst")

    @cached_property
    def neighbour_labels(self) -> DataFrame:
        """(src, src_label, nlabel, n): how many neighbours of each label."""
        return self._keep(self.edges.groupBy("src", "src_label", F.col("dst_label").alias("nlabel")).agg(F.count(F.lit(1)).alias("n")))

    def _keep(self, table: DataFrame) -> DataFrame:
        return table.persist() if self._kept else table

    @cached_property
    def neighbour_degree(self) -> DataFrame:
        """(src, mnd): the largest degree among the neighbours."""
        return self._keep(self.edges.join(self.vertices.select(F.col("id").alias("dst"), "degree"), "dst").groupBy("src").agg(F.max("degree").alias("mnd")))

    def summary(self) -> DataFrame:
        """One row: vertices, edges, largest degree, labels, largest label frequency."""
        v = self.vertices.agg(F.count(F.lit(1)).alias("n_vertices"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("n_edges"), F.max("degree").alias("max_degree"))
        return v.crossJoin(self.label_freq.agg(F.count(F.lit(1)).alias("n_labels"), F.max("n").alias("max_label_frequency")))

    def parts(self, n: int = 20, rounds: int = 0) -> DataFrame:
        """(id, label, degree, part): dealt by label and block of ids; each round then swaps vertices between parts.

        A vertex wants to go where most of its neighbours are (the first such part). From either of two parts
        as many may change to the other, those that gain most first, so parts keep their sizes.
        """
        out = self.vertices.select("id", "label", "degree", F.pmod(F.col("label") * 31 + F.floor(F.col("id") / 64), F.lit(n)).cast("int").alias("part"))
        for _ in range(rounds):
            out = settle(out)
            near = self.edges.select("src", F.col("dst").alias("id")).join(out.select("id", F.col("part").alias("to")), "id").groupBy("src", "to").agg(F.count(F.lit(1)).alias("c"))
            both = near.withColumnRenamed("src", "id").join(out, "id")
            best = both.groupBy("id", "part").agg(F.max(F.struct("c", (-F.col("to")).alias("to"))).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("c"))), F.lit(0)).alias("own"))
            moves = best.select("id", "part", (-F.col("best.to")).alias("to"), (F.col("best.c") - F.col("own")).alias("gain")).where("gain > 0")
            ranked = moves.withColumn("rank", F.row_number().over(Window.partitionBy("part", "to").orderBy(F.col("gain").desc(), "id")))
            sizes = moves.groupBy("part", "to").agg(F.count(F.lit(1)).alias("there"))
            back = sizes.select(F.col("part").alias("to"), F.col("to").alias("part"), F.col("there").alias("back"))
            going = ranked.join(sizes.join(back, ["part", "to"]).select("part", "to", F.least("there", "back").alias("most")), ["part", "to"]).where("rank <= most").select("id", "to")
            out = out.join(going, "id", "left").select("id", "label", "degree", F.coalesce("to", "part").alias("part"))
        return out

    def partitioned(self, n: int = 20, by_degree: bool = True, rounds: int = 0) -> DataFrame:
        """vertices with ``part``, sorted within a part by label and falling degree."""
        placed = self.parts(n, rounds).repartition(n, "part")
        return placed.sortWithinPartitions("part", "label", *([F.col("degree").desc()] if by_degree else []), "id")

    def label_range(self, label: int, part: int, n: int = 20, rounds: int = 0) -> DataFrame:
        """Ids of a label inside a part; empty if there is none."""
        return self.parts(n, rounds).where((F.col("label") == label) & (F.col("part") == part)).select("id")

    def edge_cut(self, n: int = 20, rounds: int = 0) -> DataFrame:
        """One row: undirected edges whose ends lie in different parts, and all edges."""
        part = self.parts(n, rounds).select("id", "part")
        ends = self.edges.where("src < dst").join(part.toDF("src", "p"), "src").join(part.toDF("dst", "q"), "dst")
        return ends.agg(F.sum(F.when(F.col("p") != F.col("q"), 1).otherwise(0)).cast("bigint").alias("cut"), F.count(F.lit(1)).alias("edges"))
