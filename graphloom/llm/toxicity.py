"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text; what ordinary text
uses as well is taken out of the toxic one. A text is cut into windows of one word; words too short
to be matched form windows with their neighbours, long ones are cut into stretches. Each window is compressed under either dictionary, between fixed ends that let short
matches show; the bytes that either side saves make the window's place in a table of calibrated
log-likelihood ratios. Windows over the thresholds are counted, and a logistic curve over their
counts and shares gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_ENTRIES, bounded_batches, crc_mod, held_out, release, worker_tool

RESULT = "score double, predicted int"


#: A fixed stretch before each window, known to both dictionaries, and one after it, known to neither:
#: the block always compresses, and matches up to the window's end are found.
_HEAD, _TAIL = b"qzjxkvwqpzyfbgqjxvkzqwpyjfgbxqzk ", b" #@0^=~}{|<>"
#: Lower-cases A-Z; other ASCII than letters and digits parts words.
_WORDS = bytes((c | 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32) for c in range(256))
#: Bytes of a window at most; saved bytes, and bytes not saved, told apart; levels of evidence told apart.
WINDOW, MOST, LEFT, LEVELS = 40, 12, 8, (0.7, 1.6, 2.5, 3.5)


@dataclass(frozen=True, eq=False)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    #: Level (0 to 4) of a window by the bytes saved on the toxic and the ordinary side and those the toxic side leaves.
    levels: np.ndarray
    weights: tuple[float, ...]
    prior: float
    cut: float


#: Words one after another of up to three bytes each, and the longer word after them, if there is one.
_SHORT = re.compile(rb"(?:(?<= )|^)([^ ]{1,3}(?: [^ ]{1,3})*)(?= |$)(?: ([^ ]+))?")


def windows(text: str) -> list[bytes]:
    """The whole text, ASCII letters lower-cased: words of letters and digits, and the runs of short ones.

    A word of four bytes or more is a window of its own. Short words one after another are one window, with the
    word after them if they have less than four bytes together. Windows over WINDOW bytes are cut into stretches.
    """
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    out = [w for w in words if len(w) > 3]
    if len(out) < len(words):
        out += [a if len(a) > 3 or not b else a + b" " + b for a, b in _SHORT.findall(b" ".join(words))]
    if max(map(len, out), default=0) > WINDOW:
        out = [w[i : i + WINDOW] for w in out for i in range(0, len(w), WINDOW)]
    return out


class _Side:
    """Bytes that a dictionary saves on a window."""

    def __init__(self, dictionary: bytes):
        import zstandard as z

        how = z.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
        kind = z.ZstdCompressionDict(dictionary + b" " + _HEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
        self.compress = z.ZstdCompressor(compression_params=how, dict_data=kind).compress
        kind.precompute_compress(compression_params=how)
        self.base = len(self.compress(_HEAD + _TAIL))

    def __call__(self, window: bytes) -> int:
        return self.base + len(window) - len(self.compress(_HEAD + window + _TAIL))


def _content(samples: list[bytes], size: int) -> bytes:
    """What a dictionary trained on the samples holds, without its tables; the samples if they are too few."""
    import zstandard as z

    total = sum(map(len, samples))
    try:
        d = z.train_dictionary(min(size, max(256, total // 4)), samples).as_bytes()
    except z.ZstdError:
        return b" ".join(samples)[:size]
    return d[min(len(d), 128) :]


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}
        self.plain, self.toxic = _Side(model.ordinary), _Side(model.toxic)

    def saved(self, window: bytes) -> tuple[int, int, int]:
        n = max(0, self.toxic(window))
        return min(MOST, n), min(MOST, max(0, self.plain(window))), min(LEFT, max(0, len(window) - n))

    def level(self, window: bytes) -> int:
        return int(self.model.levels[self.saved(window)])

    def features(self, text: str | None) -> list[float]:
        known, found = self.known, windows(text) if text else []
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = self.level(w)
        return _features(np.bincount(list(map(known.__getitem__, found)), minlength=len(LEVELS) + 1))

    def score(self, text: str | None) -> tuple[float, int]:
        x = self.model.prior + float(np.dot(self.model.weights, self.features(text)))
        p = float(1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, x)))))
        return p, int(p >= self.model.cut)


def _features(counts: np.ndarray) -> list[float]:
    """Windows at each level or above: log of the count, and share."""
    n, total, out = 0, max(20, int(counts.sum())), []
    for k in range(len(counts) - 1, 0, -1):
        n += int(counts[k])
        out += [float(np.log1p(n)), min(2.0, 20.0 * n / total)]
    return out


def _telling(plain: list[list[bytes]], bad: list[list[bytes]], least: float = 15.0, ratio: float = 8.0, seldom: int = 3) -> set[bytes]:
    """Heads of windows (4 to 12 bytes) that toxic documents hold significantly more often: what ordinary text uses too is out.

    Counted length by length: a head is only looked at if it is in ``seldom`` toxic documents without its last byte.
    """
    out: set[bytes] = set()
    shorter: set[bytes] | None = None
    for n in range(4, 13):
        a: Counter = Counter()
        for windows_ in bad:
            a.update({w[:n] for w in windows_ if len(w) >= n and (shorter is None or w[: n - 1] in shorter)})
        a = Counter({h: c for h, c in a.items() if c >= seldom})
        b: Counter = Counter()
        for windows_ in plain:
            b.update({h for w in windows_ if len(w) >= n and (h := w[:n]) in a})
        for h, c in a.items():
            x, y = c / len(bad), (b[h] + 0.5) / len(plain)
            if x >= ratio * y and c * np.log(x / y) >= least:
                out.add(h)
        shorter = set(a)
    return out


def fit_texts(texts: list[str], toxic: list[int], cut: float = 0.7, odds: float | None = None, ordinary_size: int = 4096, toxic_size: int = 16_384, stretches: int = 20_000) -> ToxicityModel:
    """Train both dictionaries, the table of evidence and the curve on the given rows.

    ``odds`` of toxic to ordinary rows among all labelled ones, if the given rows are drawn otherwise; ``stretches`` of
    eight windows at most, evenly drawn, that the ordinary dictionary is trained on.
    """
    one: dict[bytes, bytes] = {}
    found = [[one.setdefault(w, w) for w in windows(t)] for t in texts]
    return fit_windows(found, toxic, cut, odds, ordinary_size, toxic_size, stretches)


def fit_windows(found: list[list[bytes]], toxic: list[int], cut: float = 0.7, odds: float | None = None, ordinary_size: int = 4096, toxic_size: int = 16_384, stretches: int = 20_000) -> ToxicityModel:
    """``fit_texts`` from the texts' windows."""
    y = np.array(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(b"", b"", np.zeros((MOST + 1, MOST + 1, LEFT + 1), int), (0.0,) * (2 * len(LEVELS)), -3.0, cut)
    lines = lambda kind: (b" ".join(f[i : i + 8]) for f, k in zip(found, toxic) if k == kind for i in range(0, len(f), 8))
    n = sum(len(f) // 8 + 1 for f, k in zip(found, toxic) if not k)
    ordinary = _content(list(islice(lines(0), 0, None, max(1, n // stretches))), ordinary_size)
    # Toxic text is mostly ordinary words: the toxic dictionary is trained on what is left of it without them.
    heads = _telling([f for f, k in zip(found, toxic) if not k], [f for f, k in zip(found, toxic) if k])
    tells = {w for f, k in zip(found, toxic) if k for w in set(f) if any(w[:n] in heads for n in range(4, min(12, len(w)) + 1))}
    rest = [b" " + b" ".join(w for w in f if w in tells) + b" " for f, k in zip(found, toxic) if k]
    part = _content([r for r in rest if len(r) > 2], toxic_size)
    scorer = Scorer(ToxicityModel(ordinary, part, np.zeros(0), (), 0.0, cut))
    saved: dict[bytes, tuple[int, int, int]] = {}
    seen = np.full((2, MOST + 1, MOST + 1, LEFT + 1), 0.5)
    for f, k in zip(found, toxic):
        for w in f:
            if w not in saved:
                saved[w] = scorer.saved(w)
            seen[(k, *saved[w])] += 1
    ratio = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    # evidence needs some support: cells with hardly a toxic window tell nothing
    levels = np.where(seen[1] >= 3, np.digitize(ratio, LEVELS), 0)
    rows = [[1.0, *_features(np.bincount([levels[saved[w]] for w in f], minlength=len(LEVELS) + 1))] for f in found]
    w = _logistic(np.array(rows), y)
    if odds:
        w[0] += np.log(odds) - np.log(y.sum() / (len(y) - y.sum()))
    return ToxicityModel(ordinary, part, levels, tuple(float(v) for v in w[1:]), float(w[0]), cut)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    scale = np.maximum(1e-6, x.std(0))
    scale[0] = 1.0
    z, w, r = x / scale, np.zeros(x.shape[1]), np.array([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(r), z.T @ (y - p) - r * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = (3000, 1500), fold: tuple[int, int] = (3, 1), cut: float = 0.7) -> ToxicityModel:
    """Fit on about ``rows`` labelled rows (ordinary, toxic), outside the held-out fold, whole texts.

    The sample is drawn by the id's hash; the driver holds its windows, each distinct one once. The score's odds are those of all labelled rows. Null texts, ids and labels are not learned from.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod("doc_id", fold[0]) != fold[1])).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return fit_texts([], [])
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) / F.lit(1e6)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows[1] / sizes[1]))).otherwise(F.lit(min(1.0, rows[0] / sizes[0])))
    sample = known.where(place < rate)
    one: dict[bytes, bytes] = {}
    found, toxic = [], []
    for r in docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").orderBy("doc_id", "text").toLocalIterator():
        found.append([one.setdefault(w, w) for w in windows(r["text"])])
        toxic.append(r["toxic"])
    model = fit_windows(found, toxic, cut=cut, odds=sizes[1] / sizes[0])
    del one, found
    release()
    return model


def scorer_column(df: DataFrame, model: ToxicityModel, text: str | Column = "text") -> Column:
    """Column struct<score, predicted> for a text column; the model is two dictionaries of fixed size."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        scorer = worker_tool(("toxicity", id(model)), lambda: Scorer(model))
        return pd.DataFrame([scorer.score(t) for t in texts], columns=["score", "predicted"]).astype({"score": "float64", "predicted": "int32"})

    return score(F.col(text) if isinstance(text, str) else text)


def classify(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, fold: tuple[int, int] = (3, 1), cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, whole texts.

    Null and empty texts get the score of a text without a marked window; an empty table gives no rows. Without labels of both
    classes nothing can be learned and every score is that of the prior. Null ids are scored, not
    held out; repeated rows give a row each; other columns are ignored.
    """
    model = model or fit(docs, labels, fold=fold, cut=cut)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    out = rows.select("doc_id", held_out("doc_id", *fold).alias("held_out"), scorer_column(rows, model).alias("p"))
    return out.select("doc_id", "held_out", "p.score", "p.predicted")
