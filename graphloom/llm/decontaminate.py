"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Documents and items are words (lower case, runs of letters and digits) and shingles of consecutive
words. The windows are of an item's size; a document of fewer shingles is one window. Two windows can
only be similar enough if at least ``need`` of their places hold a shingle of some item of that size,
so only such windows are looked at. Equal windows, in whatever documents, are looked at once.

Windows and items get SimHash fingerprints of 64 bits, cut into four blocks. Two fingerprints within the
radius agree in one block but for a quarter of the radius: the items' blocks are put into the index
with all those bits turned, a window looks up its four blocks as they are (multi-index). Pairs within
the radius are verified by the exact weighted similarity, shingles weighing as often as they stand: sum
of minima over sum of maxima. Fingerprints of similar texts lie within the radius with high probability only;
pairs that the index does not bring together are counted by their common shingles, so none is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BitFilter, discard, literal_rows, salted_join, settle

#: Hamming radius of the index: at weighted similarity 0.8 fingerprints differ in about 10 of 64 bits.
RADIUS = 19
#: Blocks of a fingerprint, of BITS bits each.
BLOCKS, BITS = 4, 16


def words_of(text: str) -> Column:
    """Words of a text column; empty for null or wordless text."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _hashes(words: str, width: int) -> Column:
    """Hashes of all shingles of ``width`` words, by place."""
    n = F.size(words) - width + 1
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(F.col(words), i, width)))
    return F.when(n >= 1, at).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): SimHash of the hashes in column ``h`` of each key. Two 32-bit counters per sum."""
    mask, half = (1 << 32) | 1, (1 << 32) - 1
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(mask))).alias(f"s{j}") for j in range(32)]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), *sums)
    bits = []
    for j in range(32):
        for lane, place in ((F.col(f"s{j}").bitwiseAND(F.lit(half)), j), (F.shiftrightunsigned(f"s{j}", 32), j + 32)):
            bits.append(F.when(2 * lane > F.col("c"), F.shiftleft(F.lit(1).cast("bigint"), place)).otherwise(F.lit(0).cast("bigint")))
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _blocks(fp: str) -> Column:
    """array<struct<block, bits>>: the fingerprint in BLOCKS stretches."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("bits")) for k in range(BLOCKS)])


def within_radius(own: DataFrame, theirs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(k, n, fp, item_id) for every (k, n, fp) of ``own`` and (k, n, item_id, ifp) of ``theirs`` not more than the radius apart.

    Distances sum over the blocks, so one block differs in radius // BLOCKS bits at most.
    """
    turned = [m for m in range(1 << BITS) if m.bit_count() <= radius // BLOCKS]
    left = own.select("k", "n", "fp").distinct().select("k", "n", "fp", F.inline(_blocks("fp")))
    right = theirs.select("k", "n", "item_id", "ifp", F.inline(_blocks("ifp"))).withColumn("turn", F.explode(F.lit(turned)))
    right = right.select("k", "n", "item_id", "ifp", "block", F.col("bits").bitwiseXOR(F.col("turn")).alias("bits"))
    met = salted_join(left, right, ["k", "n", "block", "bits"], hint="merge")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("k", "n", "fp", "item_id").distinct()


def _windows(hits: DataFrame, percent: int) -> DataFrame:
    """(doc_id, k, last, n, m, s): windows of m shingles from s on that hold enough known places.

    ``hits`` are (doc_id, k, last, n, pos). A window holds ``need`` of them if it reaches from at or before
    one of them to the one ``need - 1`` later.
    """
    m = F.least("last", "n")
    need = F.ceil(F.lit(percent) * (m + F.col("n")) / F.lit(100.0 + percent) - 1e-9).cast("int")
    rows = hits.groupBy("doc_id", "k", "last", "n").agg(F.sort_array(F.collect_set("pos")).alias("at")).withColumn("m", m).withColumn("need", need)
    rows = rows.where((F.size("at") >= F.col("need")) & (F.col("m") >= F.col("need")))
    ends = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.get("at", i).alias("a"), F.get("at", i + F.col("need") - 1).alias("b")))
    close = F.filter(ends, lambda x: x["b"] - x["a"] < F.col("m"))
    span = rows.select("doc_id", "k", "last", "n", "m", F.inline(close))
    lo, hi = F.greatest(F.lit(0), F.col("b") - F.col("m") + 1), F.least("a", F.col("last") - F.col("m"))
    return span.where(lo <= hi).select("doc_id", "k", "last", "n", "m", F.explode(F.sequence(lo, hi)).alias("s")).distinct()


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): each item found in a document, at its best window.

    A window of an item's size, or a whole document of fewer shingles, matches when 100 * sum of minima >= percent * sum of maxima over
    shingle counts. ``first_word`` (words from 0) is the first of the best windows. Items shorter
    than ``width`` words are one shingle of all their words; items and documents without words match
    nothing, nor do rows with a null id; empty tables give no rows. Repeated rows give one row, an id that
    stands with several texts its best over them; other columns are ignored. Texts are read twice and not shuffled: a bit filter of
    fixed size tells which documents are fetched for their windows.
    """
    spark = docs.sparkSession
    item = settle(items.select("item_id", words_of("text").alias("w")).where("item_id is not null and size(w) > 0").distinct().withColumn("k", F.least(F.lit(width), F.size("w"))).withColumn("n", F.size("w") - F.col("k") + 1), "items")
    widths = sorted(r["k"] for r in item.select("k").distinct().collect())
    if not widths:
        discard(item)
        return literal_rows(spark, [], docs.select("doc_id").schema.add(items.select("item_id").schema[0]).add("similarity", "double").add("first_word", "long"))
    hashed = reduce(DataFrame.union, [item.where(F.col("k") == k).select("item_id", "k", "n", _hashes("w", k).alias("hs")) for k in widths])
    shingle = settle(hashed.select("item_id", "k", "n", F.explode("hs").alias("h")), "shingles")
    known = settle(shingle.select("k", "h", "n").distinct(), "known")

    # Places of the documents where an item's shingle stands, and the windows with enough of them.
    worded = docs.where("doc_id is not null").select("doc_id", words_of("text").alias("w"))
    places = reduce(DataFrame.union, [worded.select("doc_id", F.lit(k).alias("k"), (F.size("w") - k + 1).alias("last"), F.posexplode(_hashes("w", k)).alias("pos", "h")) for k in widths])
    held = settle(BitFilter(known, "k", "h", per_key=1024).among(places), "places")
    windows = settle(_windows(salted_join(held, known, ["k", "h"]).select("doc_id", "k", "last", "n", "pos"), percent), "windows")

    # Their hashes; a window's content is known by two hashes of them.
    found = BitFilter(windows, "doc_id").among(docs.select("doc_id", "text")).join(windows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words_of("text").alias("w"))
    # written out, as an expression that is read for every window would be computed for every window
    sequences = settle(reduce(DataFrame.union, [found.select("doc_id", F.lit(k).alias("k"), _hashes("w", k).alias("hs")) for k in widths]), "sequences")
    at = windows.groupBy("doc_id", "k", "last").agg(F.collect_list(F.struct("n", "m", "s")).alias("at"))
    cut = sequences.withColumn("last", F.size("hs")).join(at, ["doc_id", "k", "last"]).select("doc_id", "k", F.inline(F.transform("at", lambda a: F.struct(a["n"].alias("n"), a["m"].alias("m"), a["s"].alias("s"), F.slice("hs", a["s"] + 1, a["m"]).alias("part")))))
    own = settle(cut.select("doc_id", "k", "n", "m", "s", F.xxhash64("part").alias("c1"), F.xxhash64("part", F.lit(1)).alias("c2"), "part"), "cut")
    content = ["k", "n", "m", "c1", "c2"]
    parts = settle(own.groupBy(*content).agg(F.first("part").alias("part")), "contents")

    # Candidates by fingerprint, verified; then the pairs that no fingerprint brought together.
    prints = settle(fingerprints(parts.select(*content, F.explode("part").alias("h")), content), "fingerprints")
    theirs = fingerprints(shingle, ["item_id", "k", "n"]).withColumnRenamed("fp", "ifp")
    near = settle(salted_join(prints, within_radius(prints, theirs, radius), ["k", "n", "fp"]).select(*content, "item_id"), "candidates")
    bag = settle(shingle.groupBy("item_id", "k", "n", "h").agg(F.count(F.lit(1)).alias("y")), "bags")
    mine = settle(parts.select(*content, F.explode("part").alias("h")).groupBy(*content, "h").agg(F.count(F.lit(1)).alias("x")), "mine")

    def verified(pairs: DataFrame) -> DataFrame:
        """The bags have m and n shingles, so the maxima sum to m + n less the minima."""
        both = pairs.groupBy(*content, "item_id").agg(F.sum(F.least("x", "y")).alias("both"))
        return both.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("m") + F.col("n") - F.col("both")))

    by_index = verified(mine.join(near, content).join(bag, ["item_id", "k", "n", "h"]))
    rest = verified(salted_join(mine, bag, ["k", "n", "h"]).join(near, [*content, "item_id"], "left_anti"))
    passed = settle(by_index.union(rest), "passed")
    met = salted_join(own.drop("part"), passed, content).withColumn("similarity", F.col("both") / (F.col("m") + F.col("n") - F.col("both")))
    best = met.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"))).alias("m"))
    out = settle(best.select("doc_id", "item_id", "m.similarity", (-F.col("m.s")).cast("bigint").alias("first_word")), "leaks")
    for t in (item, shingle, known, held, windows, sequences, own, parts, prints, near, bag, mine, passed):
        discard(t)
    return out


#: DuckDB: every window of every item's size against that item, without fingerprints.
ORACLE = r"""
WITH it AS MATERIALIZED (
  SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ik AS MATERIALIZED (SELECT item_id, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS n FROM it WHERE len(w) > 0),
ish AS MATERIALIZED (SELECT item_id, k, n, list_aggregate(w[i:i+k-1], 'string_agg', ' ') AS h FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM ik)),
bag AS MATERIALIZED (SELECT item_id, k, n, h, count(*) AS y FROM ish GROUP BY ALL),
dw AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ks AS (SELECT DISTINCT k FROM ik),
pos AS MATERIALIZED (
  SELECT doc_id, k, len(w) - k + 1 AS last, i - 1 AS p, list_aggregate(w[i:i+k-1], 'string_agg', ' ') AS h
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT pos.doc_id, pos.k, pos.p, pos.h, last, item_id, n, y FROM pos JOIN bag ON pos.k = bag.k AND pos.h = bag.h),
win AS (SELECT doc_id, k, n, item_id, h, y, unnest(range(greatest(0, p - n + 1), least(p, last - n) + 1)) AS s FROM hit WHERE last >= n),
tf AS (SELECT doc_id, k, n, item_id, s, h, y, count(*) AS x FROM win GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, n, s, sum(least(x, y)) AS b FROM tf GROUP BY doc_id, item_id, n, s),
ok AS (SELECT * FROM both_ WHERE 100 * b >= 80 * (2 * n - b))
SELECT doc_id, item_id, (max(b) / (2 * max(n) - max(b)))::DOUBLE AS similarity, arg_min(s, (-b, s))::BIGINT AS first_word
FROM ok GROUP BY doc_id, item_id
"""
