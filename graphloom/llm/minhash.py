"""Near-duplicate documents by fast similarity sketching.

A document's shingle set is sketched into ``BINS`` bins: in the first rounds every element is
thrown into a hashed bin, round after round until all bins hold something; the last rounds
fill bin after bin by plain minima, so every coordinate is filled for certain. Coordinates agree
with the sets' similarity, concentrated as if independent. Bands of coordinates give buckets.

Equal sets become one class first. In every bucket all members are verified against the smallest
one (a star, linear in the bucket); buckets that still hold members of several components are
compared block by block, and only pairs across components whose sketches agree are verified. All
verification is on full sets. Nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_ENTRIES, BitFilter, discard, salted_join, settle, small_batches, text_batches, worker_tool
from graphloom.llm.components import components

#: Coordinates; coordinates to a band (packed as 16 bits each into one long); seeds of the rounds.
BINS, ROWS = 128, 4
_B = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * _B + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def sketch(h: np.ndarray) -> np.ndarray:
    """BINS 16-bit coordinates of a non-empty set of hashes."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out, r = np.full(BINS, empty), 0
    while r < BINS:
        step = max(1, min(BINS - r, 2048 // len(h)))
        x = mix(h[None, :] + _SEEDS[r : r + step, None])
        rounds = np.arange(r, r + step, dtype=np.uint64)[:, None] << np.uint64(56)
        np.minimum.at(out, (x & np.uint64(BINS - 1)).astype(np.intp).ravel(), (rounds | (x >> np.uint64(8))).ravel())
        r += step
        if not (out == empty).any():
            break
    for b in np.flatnonzero(out == empty):
        out[b] = np.uint64((BINS + int(b)) << 56) | (mix(h + _SEEDS[BINS + b]).min() >> np.uint64(8))
    return (mix(out) >> np.uint64(48)).astype("<u2")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), bands (packed coordinates)."""

    def run(batches):
        shingles = worker_tool(("shingles", width), lambda: Shingler(width))
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for _, texts in text_batches(batch):
                for t in texts:
                    h = shingles(t)
                    n.append(len(h))
                    f1.append(int(mix(h).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(h ^ _SEEDS[0]).sum(dtype=np.uint64).view(np.int64)))
                    bands.append(sketch(h).view("<i8") if len(h) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set): the sorted hashes of the documents whose id is in ``ids``, as bytes. Texts are not shuffled."""

    def run(batches):
        shingles = worker_tool(("shingles", width), lambda: Shingler(width))
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([shingles(t).tobytes() for _, texts in text_batches(batch) for t in texts], pa.binary())], ["id", "set"])

    some = BitFilter(ids, "id").among(docs.select(F.col("doc_id").alias("id"), "text")).mapInArrow(run, "id bigint, set binary")
    return settle(some.join(ids, "id", "left_semi").where("length(set) > 0").distinct(), "sets")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def run(batches):
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # a bucket's smallest member stands in as many pairs as the bucket has members
    joined = salted_join(pairs.select("a", "b"), sets.toDF("a", "x"), ["a"]).join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return settle(joined.mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _blockwise(members: DataFrame, percent: int, exact: bool, block: int = 512, least: float = 0.62) -> DataFrame:
    """Compare the members of each bucket (pos, band) across components, in pairs of hashed blocks.

    A pair counts in the first bucket that its members share, if sizes and sketches allow the
    similarity (at the threshold a sketch does not with a probability below 1e-6). Not ``exact``: the
    members (pos, band, rep) with such a partner. ``exact``: members carry their sets, pairs are
    verified, and a spanning forest (a, b) of the links returns. Rows never outnumber members of blocks.
    """
    counted = members.groupBy("pos", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / (2000 * block))).cast("int").alias("blocks"))
    sized = salted_join(members, counted, ["pos", "band"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("blocks", "other")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        pos, band, i, j = (int(group[c].iloc[0]) for c in ("pos", "band", "i", "j"))
        mine, rep, comp, size = (group[c].to_numpy() for c in ("mine", "rep", "comp", "size"))
        bands = np.stack([np.asarray(b, "<i8") for b in group["bands"]])
        sig = bands.view("<u2")
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        sets = [np.frombuffer(x, np.uint64) for x in group["set"]] if exact else None
        flagged, out, root = np.zeros(len(group), bool), [], comp.copy()
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            y = y[(sig[y] == sig[x]).mean(1) >= least] if len(y) else y
            y = y[(bands[y] == bands[x]).argmax(1) == pos] if len(y) else y
            if not exact:
                flagged[y] = True
                flagged[x] |= len(y) > 0
                continue
            for k in y:
                if root[k] != root[x] and _similar(sets[x], sets[k], percent):
                    out.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
                    root[root == root[k]] = root[x]
        if exact:
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        return pd.DataFrame({"pos": np.int32(pos), "band": np.int64(band), "rep": rep[flagged]})

    return dealt.groupBy("pos", "band", "i", "j").applyInPandas(compare, "a bigint, b bigint" if exact else "pos int, band bigint, rep bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Links join documents whose sets of ``width``-word shingles (ASCII lower case, words by ASCII
    white space; the whole sequence when shorter) have 100 * intersection >= percent * union. A
    component's id is the smallest doc_id in it. Null and empty texts have an empty set and link
    with nothing; rows with a null id are not linked, their component_id is null and they are kept.
    Rows of one id belong together, whatever their texts: each gets its own n_shingles and the id's component.
    An empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, width, percent)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    every = settle(_sketches(rows, width), "sketches")
    linked = every.where("n_shingles > 0 and doc_id is not null")
    classes = settle(linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    of = settle(salted_join(linked.select("doc_id", "n_shingles", "f1", "f2"), classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("doc_id", "n_shingles", "rep"), "of")
    # an id that stands with several texts links their classes
    ends = of.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    own = of.join(ends, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    member = settle(classes.select("rep", F.posexplode("bands").alias("pos", "band")), "bands")
    shared = settle(member.groupBy("pos", "band").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    held = settle(salted_join(member, shared, ["pos", "band"]), "members")
    pairs = settle(held.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sets = _full_sets(rows, held.select(F.col("rep").alias("id")).distinct(), width)
    links = settle(verify(pairs, sets, percent).union(own), "links")
    found = components(links)
    # Buckets of three or more that still hold several components: their other pairs.
    named = settle(held.where("n > 2").select("pos", "band", "rep").join(found.toDF("rep", "comp"), "rep", "left").select("pos", "band", "rep", F.coalesce("comp", "rep").alias("comp")), "named")
    mixed = named.groupBy("pos", "band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("pos", "band")
    open_members = settle(salted_join(named, mixed, ["pos", "band"]).join(classes.select("rep", "size", "bands"), "rep"), "open")
    paired = settle(_blockwise(open_members, percent, exact=False), "paired")
    if not paired.isEmpty():
        full = settle(open_members.join(paired, ["pos", "band", "rep"]).join(sets.toDF("rep", "set"), "rep"), "full")
        extra = settle(_blockwise(full, percent, exact=True), "links")
        if not extra.isEmpty():
            old, found = found, components(links.union(extra))
            discard(old)
        discard(full)
        discard(extra)
    in_class = of.join(found.toDF("rep", "comp"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))
    alone = every.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = settle(in_class.union(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near")
    for t in (every, classes, of, member, held, shared, pairs, sets, links, found, named, open_members, paired):
        discard(t)
    return out
