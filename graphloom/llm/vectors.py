"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by sign flips and fast Hadamard transforms; the coordinate of the largest
magnitude, with its sign, is its hash. A few hashes make a bucket of one table. Each vector lives in
one bucket of a table and also visits the next likely ones (multiprobe). A pair meets where one
lives and the other lives or visits; its cosine is computed in double precision, and it is counted
in the first place where the two meet, so no list of pairs is ever shuffled.

Equal vectors become one class with a weight. A table has so many buckets that vectors without a near one
mostly stand alone, and vectors go only where another one is. Large buckets are compared block by block; a group gives back
each vector's number of links and a spanning forest, not its pairs.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, one_thread, salted_join, settle
from graphloom.llm.components import components

#: Buckets of a table that a vector is found in: its own, and the next best by either of two hashes.
PROBES = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def bucket_keys(x: np.ndarray, tables: int, hashes: int, seed: int = 7) -> np.ndarray:
    """Per row, tables x PROBES keys, to be told apart by table; the first of a table is the home bucket."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng, rows, out = np.random.default_rng((seed, d)), np.arange(n), np.zeros((n, tables, PROBES), np.int64)
    for t in range(tables):
        best, second, gap = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            m = np.abs(y)
            a = m.argmax(1)
            top = m[rows, a]
            m[rows, a] = -1
            b = m.argmax(1)
            code = lambda k: 2 * k + (y[rows, k] < 0)
            best.append(code(a))
            second.append(code(b))
            gap.append(top - m[rows, b])
        order = np.argsort(np.stack(gap, 1), axis=1, kind="stable")
        for p in range(PROBES):
            key = np.zeros(n, np.int64)
            for k in range(hashes):
                turned = p > 0 and order[:, min(p - 1, hashes - 1)] == k
                key = key * (2 * size + 1) + np.where(turned, second[k], best[k])
            out[:, t, p] = key
    return out.reshape(n, tables * PROBES)


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id and the vector's components as bytes; null if it is null, empty, zero or not all finite numbers."""

    def run(batches):
        for batch in batches:
            column, out = batch.column(1), []
            for v in column:
                a = None if v.as_py() is None else v.values
                if a is None or not len(a) or a.null_count:
                    out.append(None)
                    continue
                x = a.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id bigint, vec binary")


def _unit(vecs, kind: str = "<f8") -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(kx: np.ndarray, ky: np.ndarray, table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of pairs with keys kx and ky (pairs x tables x PROBES), seen in bucket (table, key), those that meet there first."""
    keep, rows = np.ones(len(kx), bool), np.arange(len(kx))
    for t in range(int(table.max(initial=0))):
        a, b = kx[:, t], ky[:, t]
        keep &= (t >= table) | ~((a[:, :1] == b).any(1) | (b[:, :1] == a).any(1))
    a, b = kx[rows, table], ky[rows, table]
    both = (a[:, :1] == b).any(1) & (b[:, :1] == a).any(1)
    return keep & ((a[:, 0] == key) | (b[:, 0] == key)) & ~(both & (np.minimum(a[:, 0], b[:, 0]) != key))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees (labels point to smaller places, roots to themselves) of each a and b."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label[:] = label[label]


#: Rows compared together; members of a bucket up to which its pairs are listed beside those of other buckets.
TOGETHER, SMALL = 16_384, 48


class _Comparer:
    """Links within groups of rows (rep, weight, table, key, i, j, mine, vec, keys), groups one after another."""

    def __init__(self, threshold: float, tables: int, kind: str, key_kind: str):
        self.threshold, self.tables, self.kind, self.key_kind = threshold, tables, kind, key_kind

    def pairs(self, sizes: np.ndarray, starts: np.ndarray, i, j, mine):
        """(a, b) index arrays: small groups all at once, then large ones in strips."""
        small = np.flatnonzero((sizes <= SMALL) & (i[starts] == j[starts]))
        for size in np.unique(sizes[small]):
            if size > 1:
                at = starts[small[sizes[small] == size]]
                x, y = np.triu_indices(int(size), 1)
                for k in range(0, len(at), max(1, 400_000 // len(x))):
                    part = at[k : k + max(1, 400_000 // len(x)), None]
                    yield (part + x).ravel(), (part + y).ravel(), None
        for g in np.setdiff1d(np.arange(len(sizes)), small):
            rows = np.arange(starts[g], starts[g] + sizes[g])
            own = mine[rows]
            left, right = rows[own == i[rows[0]]], rows[own == j[rows[0]]]
            for k in range(0, len(left), 256):
                yield left[k : k + 256], right, i[rows[0]] == j[rows[0]]

    def __call__(self, t: pa.Table) -> pa.RecordBatch:
        one_thread()
        rep, weight, table, key, i, j, mine = (t[c].to_numpy() for c in ("rep", "weight", "table", "key", "i", "j", "mine"))
        vecs = t["vec"].to_pylist()
        wide = np.array([len(v) for v in vecs])
        keys = np.frombuffer(b"".join(t["keys"].to_pylist()), self.key_kind).reshape(len(t), self.tables, PROBES)
        starts = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        sizes = np.diff(np.r_[starts, len(t)])
        x = np.zeros((len(t), int(wide.max()) // np.dtype(self.kind).itemsize))
        for w in np.unique(wide):
            at = np.flatnonzero(wide == w)
            x[at, : w // np.dtype(self.kind).itemsize] = _unit([vecs[k] for k in at], self.kind)
        local = (key % (1 << 32)).astype(keys.dtype) if keys.dtype.itemsize < 8 else key
        degree, label = np.zeros(len(t), np.int64), np.arange(len(t))
        for a, b, strip in self.pairs(sizes, starts, i, j, mine):
            if strip is None:
                hit = np.einsum("nd,nd->n", x[a], x[b]) >= self.threshold
                a, b = a[hit], b[hit]
            else:
                p, q = np.nonzero(x[a] @ x[b].T >= self.threshold)
                a, b = a[p], b[q]
                if strip:
                    a, b = a[a < b], b[a < b]
            alike = wide[a] == wide[b]
            a, b = a[alike], b[alike]
            hold = _first_meeting(keys[a], keys[b], table[a], local[a])
            a, b = a[hold], b[hold]
            np.add.at(degree, a, weight[b])
            np.add.at(degree, b, weight[a])
            _merge(label, a, b)
        some = (degree > 0) | (label != np.arange(len(t)))
        return pa.record_batch([pa.array(rep[some]), pa.array(rep[label[some]]), pa.array(degree[some])], ["rep", "other", "links"])

    def run(self, batches):
        """Whole groups at a time; the last group of what has been read waits for more."""
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) >= TOGETHER:
                columns = [held[c].to_numpy() for c in ("table", "key", "i", "j")]
                same = np.logical_and.reduce([c == c[-1] for c in columns])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield self(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and len(held):
            yield self(held)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = 14, hashes: int | None = None, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row, links at cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different length; rows with a null id are not linked, their component_id is null
    and they are kept; repeated rows count as vectors of their own. ``hashes`` per table grows with
    the logarithm of the number of distinct vectors, which keeps buckets small. An empty table gives no rows; other columns are
    ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    every = settle(_vectors(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), kind), "vectors")
    linked = every.where("vec is not null and vec_id is not null")
    classes = settle(linked.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "classes")
    n, wide = (classes.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()[k] or 1 for k in (0, 1))
    wide = max(2, wide // np.dtype(kind).itemsize)
    hashes = hashes or max(2, round(log(4 * max(2, n)) / log(2 * wide)))
    # a key below the length and the table fits into as many bytes as its hashes take
    codes = (2 * (1 << max(1, (wide - 1).bit_length())) + 1) ** hashes
    key_kind = "<u2" if codes < 1 << 16 else "<u4" if codes < 1 << 32 else "<i8"

    def hash_all(batches):
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            keys, longs = [b""] * len(vecs), [None] * len(vecs)
            for size in {len(v) for v in vecs}:
                at = [k for k, v in enumerate(vecs) if len(v) == size]
                for s in range(0, len(at), 1024):
                    part = at[s : s + 1024]
                    found = bucket_keys(_unit([vecs[k] for k in part], kind), tables, hashes)
                    if key_kind != "<i8":
                        found = found + (np.int64(size) << 32)
                    for k, row in zip(part, found):
                        keys[k], longs[k] = row.astype(key_kind).tobytes(), row
            yield pa.record_batch([batch.column(1), batch.column(2), batch.column(0), pa.array(keys, pa.binary()), pa.array(longs, pa.list_(pa.int64()))], ["rep", "weight", "vec", "keys", "buckets"])

    hashed = settle(classes.select("vec", "rep", "weight").mapInArrow(hash_all, "rep bigint, weight bigint, vec binary, keys binary, buckets array<bigint>"), "hashed")
    met = settle(hashed.select("rep", F.posexplode("buckets").alias("pos", "key")).select("rep", "key", F.floor(F.col("pos") / PROBES).cast("int").alias("table"), (F.col("pos") % PROBES).alias("probe")), "met")
    shared = settle(met.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("home")).where("n > 1 and home = 0").select("table", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shared")
    placed = salted_join(met.select("table", "key", "rep"), shared, ["table", "key"]).withColumn("mine", F.pmod(F.xxhash64("rep", "table"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("table", "key", F.least("mine", "o").alias("i"), F.greatest("mine", "o").alias("j"), "mine", "rep")
    full = dealt.join(hashed.select("rep", "weight", "vec", "keys"), "rep")
    group = ["table", "key", "i", "j"]
    compare = _Comparer(threshold, tables, kind, key_kind)
    ordered = full.select(*group, "mine", "rep", "weight", "vec", "keys").repartition(*group).sortWithinPartitions(*group)
    found = settle(ordered.mapInArrow(compare.run, "rep bigint, other bigint, links bigint"), "links")
    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> other"), "rep", "other").toDF("rep", "comp")
    of = settle(classes.join(degree, "rep", "left").join(joined, "rep", "left").select("vec", F.coalesce("comp", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links")), "of")
    out = salted_join(linked, of, ["vec"]).select("vec_id", "n_links", "component_id")
    alone = every.where("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = settle(out.union(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near")
    for t in (every, classes, hashed, met, shared, found, joined, of):
        discard(t)
    return out
