"""Quality selection by importance resampling.

Two generative models over hashed n-grams are fitted: one on target text (documents labelled good), one on
the raw corpus. A document's importance weight is the ratio of its probabilities under the two, so
its logarithm is the sum of its n-grams' log ratios; Gumbel noise added to that makes the key whose
top k are a sample without replacement in proportion to the weights.

N-grams are words and punctuation runs, as they are written, and pairs of neighbours. Raw counts cover all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_ENTRIES, crc_mod, held_out, settle, text_batches

BUCKETS = 1 << 16
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hasher:
    """Bucket of every n-gram of a text, words and pairs."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for t in set(tokens):
            if t not in known:
                known[t] = crc32(t.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(40)
        return np.concatenate([h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype(np.int64)


@dataclass(frozen=True, eq=False)
class QualityModel:
    log_ratio: np.ndarray


def _bag(rows: DataFrame) -> np.ndarray:
    """N-gram counts by bucket over all rows; a task sends each bucket once."""

    def run(batches):
        hasher, total = Hasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in text_batches(batch):
                for t in texts:
                    total += np.bincount(hasher(t), minlength=BUCKETS) if len(t) > 40_000 else 0
                short = [hasher(t) for t in texts if len(t) <= 40_000]
                total += np.bincount(np.concatenate([*short, np.zeros(0, np.int64)]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.float64)
    found = rows.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = 6000, fold: tuple[int, int] = (3, 1), smooth: float = 0.5) -> QualityModel:
    """Target: about ``target_rows`` documents labelled quality 1 outside the held-out fold, drawn by the id's hash, whole. Raw: all."""
    good = labels.where((F.col("quality") == 1) & (crc_mod("doc_id", fold[0]) != fold[1])).select("doc_id").distinct()
    n = good.count()
    raw = _bag(docs)
    if not n or not raw.sum():
        return QualityModel(np.zeros(BUCKETS))
    sample = good.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / F.lit(1e6) < min(1.0, target_rows / n))
    target = _bag(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    # the target is smoothed towards the raw model, so that what it happens not to hold says little
    share = raw / raw.sum()
    prior = 20_000.0 * smooth
    return QualityModel(np.log((target + prior * share + 1e-3) / (target.sum() + prior + 1e-3 * BUCKETS)) - np.log((raw + 1e-3) / (raw.sum() + 1e-3 * BUCKETS)))


def _threshold(keys: DataFrame, k: int) -> tuple[float, int]:
    """(key, rid) of the k-th row by falling key, then rid: histograms narrow it to a few rows."""
    lo, hi = (float(x) for x in keys.agg(F.min("key"), F.max("key")).first())
    above = 0
    while hi > lo:
        width = (hi - lo) / 1024
        if lo + width <= lo:
            break
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        bins = inside.groupBy(F.least(F.lit(1023), F.floor((F.col("key") - lo) / width)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if n <= 1000:
            break
    rows = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).orderBy(F.col("key").desc(), "rid").limit(k - above).select("key", "rid").tail(1)
    return rows[0]["key"], rows[0]["rid"]


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.85, temperature: float = 1.0, model: QualityModel | None = None, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, n_grams, log_weight, key, selected: one row per input row, ceil(fraction * rows) selected.

    ``log_weight`` is the log importance weight of the whole text; a ``temperature`` other than 1 divides it in the key.
    Null and empty texts have no n-gram and weight 0 (log); noise is drawn from id and text, so reruns agree; equal keys are told apart by
    row. Without labels all weights are equal. An empty table gives no rows; other columns are ignored.
    """
    model = model or fit(docs, labels, fold=fold)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(88)).alias("noise"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        hasher, table, rid = Hasher(), shared.value.log_ratio, TaskContext.get().partitionId() << 33
        for batch in batches:
            n, weight = [], []
            for _, texts in text_batches(batch):
                for t in texts:
                    h = hasher(t)
                    n.append(len(h))
                    weight.append(float(table[h].sum()))
            yield pa.record_batch([pa.array(range(rid, rid + len(n)), pa.int64()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(weight, pa.float64())], ["rid", "doc_id", "noise", "n_grams", "log_weight"])
            rid += len(n)

    scored = rows.mapInArrow(run, f"rid bigint, doc_id {id_type}, noise bigint, n_grams bigint, log_weight double")
    uniform = (F.shiftrightunsigned("noise", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keys = settle(scored.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(uniform))), "keys")
    total = keys.count()
    k = -int(-fraction * total // 1)
    chosen = F.lit(True)
    if k < total:
        key, rid = _threshold(keys, k)
        chosen = (F.col("key") > key) | ((F.col("key") == key) & (F.col("rid") <= rid))
    return keys.select("doc_id", held_out("doc_id", *fold).alias("held_out"), "n_grams", "log_weight", "key", chosen.alias("selected"))
