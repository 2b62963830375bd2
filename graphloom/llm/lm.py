"""Gated recurrent language model: whole-document log probabilities.

Tokens are words (ASCII lower case, by ASCII white space) and one end per document. The output
softmax is factored into classes: the most frequent words form classes of their own size and are
predicted inside them; all other words fall into tail classes by their ending, inside which a
word has its smoothed share of the class's count over the whole training corpus. The state before
a token predicts it; it is carried across windows, so a document is scored as a whole.

Counts cover all training documents, and so do the weights. They are trained by truncated
backpropagation in numpy, in rounds: in each, every partition trains on its share of another slice of
the training documents and the weights are averaged. The rounds together take every document once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import isqrt, log10
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import crc_mod, held_out, one_thread, settle, text_batches, worker_tool

LOG10 = float(np.log(10.0))
#: Words predicted one by one; words to a class; classes of the other words; hidden and input size.
HEAD, CLASS, TAIL, HIDDEN = 2048, 64, 64, 24
#: Rounds of training, each on another slice of the documents.
ROUNDS = 4
#: Words looked up in memory, at most: the most frequent ones down to a power of two. The others meet their counts in a join.
FREQUENT = 1 << 19


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return crc32(word[-3:]) % TAIL


class Places(dict):
    """Places of words; -1 for others."""

    def __missing__(self, word) -> int:
        return -1


@dataclass(eq=False)
class Vocabulary:
    """Head words by falling count (the end token last), frequent words' counts, and the tail classes' totals."""

    head: list[bytes]
    head_counts: np.ndarray
    frequent: list[bytes]
    frequent_counts: np.ndarray
    tail_tokens: np.ndarray
    tail_words: np.ndarray
    tokens: int
    words: int
    documents: int

    def __post_init__(self):
        self.end = len(self.head)
        self.inputs = len(self.head) + 1 + TAIL
        self.head_classes = -(-(len(self.head) + 1) // CLASS)
        self.classes = self.head_classes + TAIL

    def base(self, c) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 0.1) / (self.tokens + 0.1 * (self.words + 1)))

    def tail_share(self, c, k) -> np.ndarray:
        return np.log10((np.asarray(c, float) + 0.1) / (self.tail_tokens[k] + 0.1 * (self.tail_words[k] + 1)))

    def lookup(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """Frequent word -> place; by place: input id, base log10, log10 share within the tail class (0 in the head)."""
        at = {w: k for k, w in enumerate(self.head)}
        cls = np.array([tail_class(w) for w in self.frequent], np.int64) if self.frequent else np.zeros(0, np.int64)
        ids = np.array([at.get(w, -1) for w in self.frequent], np.int32) if self.frequent else np.zeros(0, np.int32)
        share = np.where(ids >= 0, 0.0, self.tail_share(self.frequent_counts, cls)) if len(ids) else np.zeros(0)
        return Places((w, k) for k, w in enumerate(self.frequent)), np.where(ids >= 0, ids, self.end + 1 + cls).astype(np.int32), self.base(self.frequent_counts), share


def first_weights(v: Vocabulary, hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    counts = np.append(v.head_counts, v.documents) + 0.1
    by_class = np.append(np.add.reduceat(counts, np.arange(0, len(counts), CLASS)), v.tail_tokens + 0.1)
    small = lambda *s: rng.normal(0, 0.08, s).astype(np.float32)
    zero = lambda *s: np.zeros(s, np.float32)
    return {
        "E": small(v.inputs, hidden), "Wx": rng.normal(0, 0.25, (hidden, 2 * hidden)).astype(np.float32), "b": zero(2 * hidden), "U": rng.normal(0, 0.25, (hidden, 2 * hidden)).astype(np.float32),
        "Wc": small(hidden, v.classes), "bc": np.log(by_class / by_class.sum()).astype(np.float32), "Wo": small(v.end + 1, hidden), "bo": np.log(counts).astype(np.float32),
    }


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _classes_of(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return np.where(ids <= v.end, ids // CLASS, v.head_classes + ids - v.end - 1)


def _log_probs(w, h: np.ndarray, ids: np.ndarray, v: Vocabulary, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each id from its state; with ``grads``, also adds the loss's gradients and returns that of h."""
    cls, n = _classes_of(ids, v), np.arange(len(ids))
    # a row for each class, so that sums over classes run along rows
    p = w["Wc"].T @ h.T
    p += w["bc"][:, None]
    p -= p.max(0)
    out = p[cls, n]
    np.exp(p, out=p)
    total = p.sum(0)
    out -= np.log(total)
    dh = None
    if grads is not None:
        p /= total
        p[cls, n] -= 1
        grads["Wc"] += (p @ h).T
        grads["bc"] += p.sum(1)
        dh = np.ascontiguousarray((w["Wc"] @ p).T)
    inner = np.flatnonzero(ids <= v.end)
    order = inner[np.argsort(cls[inner], kind="stable")]
    bounds = np.flatnonzero(np.diff(cls[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = order[a:b]
        lo = int(cls[rows[0]]) * CLASS
        hi = min(lo + CLASS, v.end + 1)
        held, k, at = h[rows], np.arange(len(rows)), ids[rows] - lo
        q = w["Wo"][lo:hi] @ held.T
        q += w["bo"][lo:hi, None]
        q -= q.max(0)
        found = q[at, k]
        np.exp(q, out=q)
        t = q.sum(0)
        out[rows] += found - np.log(t)
        if grads is not None:
            q /= t
            q[at, k] -= 1
            grads["Wo"][lo:hi] += q @ held
            grads["bo"][lo:hi] += q.sum(1)
            dh[rows] += q.T @ w["Wo"][lo:hi]
    return out, dh


def _step(a: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gate, candidate, next state) from the input's part ``a``: the gate keeps of the state what it does not take from the candidate."""
    size = h.shape[1]
    g = h @ u
    g += a
    z = _sigmoid(g[:, :size])
    n = np.tanh(g[:, size:])
    new = h - n
    new *= z
    new += n
    return z, n, new


def window_gradients(w: dict, x: np.ndarray, real: np.ndarray, h: np.ndarray, v: Vocabulary) -> tuple[float, dict, np.ndarray]:
    """(loss, gradients of its sum, last state) of a window x (lanes x steps) from state h, where ``real``; backpropagation ends at the window's start."""
    (lanes, t_all), size = x.shape, w["U"].shape[0]
    xt = np.ascontiguousarray(x.T)
    e = w["E"][xt]
    proj = e @ w["Wx"] + w["b"]
    keep = (xt != v.end).astype(w["U"].dtype)[:, :, None]
    saved, before = [], np.zeros((t_all, lanes, size), w["U"].dtype)
    for t in range(t_all):
        before[t] = h
        z, n, h = _step(proj[t], h, w["U"])
        saved.append((z, n))
        h = h * keep[t]
    grads = {k: np.zeros_like(a) for k, a in w.items()}
    told, dout = real.T, np.zeros((t_all, lanes, size), w["U"].dtype)
    logs, dout[told] = _log_probs(w, before[told], xt[told], v, grads)
    dproj, dh, back = np.empty_like(proj), np.zeros((lanes, size), w["U"].dtype), w["U"].T.copy()
    for t in range(t_all - 1, -1, -1):
        z, n = saved[t]
        dh *= keep[t]
        kept = dh * z
        dg = dproj[t]
        np.multiply(kept * (before[t] - n), 1 - z, out=dg[:, :size])
        np.multiply(dh - kept, 1 - n * n, out=dg[:, size:])
        dh = dg @ back
        dh += kept
        dh += dout[t]
    flat = dproj.reshape(-1, 2 * size)
    grads["U"] += before.reshape(-1, size).T @ flat
    grads["Wx"] += e.reshape(-1, size).T @ flat
    grads["b"] += flat.sum(0)
    order = np.argsort(xt, axis=None, kind="stable")
    found, first = np.unique(xt.reshape(-1)[order], return_index=True)
    grads["E"][found] = np.add.reduceat((flat @ w["Wx"].T)[order], first)
    return -float(logs.sum()), grads, h


def train(w: dict, docs: list[np.ndarray], v: Vocabulary, lanes: int = 32, steps: int = 16, rate: float = 0.01, most: int = 512, updates: int = 128) -> dict:
    """One pass of truncated backpropagation with Adam over all tokens of the documents, dealt over parallel lanes.

    Long streams get up to ``most`` lanes, as long as ``updates`` steps of Adam are left.
    """
    if not docs:
        return w
    one_thread()
    stream = np.concatenate(docs)
    lanes = max(lanes, min(most, len(stream) // (steps * updates)))
    lanes = max(1, min(lanes, len(stream) // (2 * steps) or 1))
    width = -(-len(stream) // lanes)
    real = (np.arange(lanes * width) < len(stream)).reshape(lanes, width)
    ids = np.append(stream, np.full(lanes * width - len(stream), v.end)).astype(np.int32).reshape(lanes, width)
    w = {k: x.copy() for k, x in w.items()}
    m, s = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    h, turn = np.zeros((lanes, w["U"].shape[0]), np.float32), 0
    for at in range(0, width, steps):
        told = real[:, at : at + steps]
        _, grads, h = window_gradients(w, ids[:, at : at + steps], told, h, v)
        turn += 1
        scale = 1.0 / told.sum()
        for k, g in grads.items():
            g *= scale
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            w[k] -= rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(s[k] / (1 - 0.99**turn)) + 1e-6)
    return w


class Model:
    """Scores many documents at once: lanes take the next document when theirs ends, the longest first."""

    def __init__(self, w: dict, v: Vocabulary, lanes: int = 256, window: int = 64):
        self.w, self.v, self.lanes, self.window = w, v, lanes, window
        self.proj = w["E"] @ w["Wx"] + w["b"]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document's ids."""
        one_thread()
        w, v, size, out = self.w, self.v, self.w["U"].shape[0], np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        lanes = min(self.lanes, len(docs))
        own, at, queue = np.full(lanes, -1), np.zeros(lanes, np.int64), iter(order)
        h = np.zeros((lanes, size), np.float32)
        while True:
            for b in range(lanes):
                if own[b] < 0 or at[b] >= len(docs[own[b]]):
                    own[b] = next(queue, -1)
                    at[b] = 0
                    h[b] = 0
            live = own >= 0
            if not live.any():
                return out
            if not live.all():
                own, at, h = own[live], at[live], h[live]
                lanes = len(own)
            x = np.full((self.window, lanes), v.end, np.int32)
            count = np.zeros(lanes, np.int64)
            for b in range(lanes):
                part = docs[own[b]][at[b] : at[b] + self.window]
                count[b] = len(part)
                x[: len(part), b] = part
            steps = int(count.max())
            before = np.zeros((steps, lanes, size), np.float32)
            proj = self.proj[x[:steps]]
            for t in range(steps):
                before[t] = h
                h = _step(proj[t], h, w["U"])[2]
            real = np.arange(steps)[:, None] < count
            logs, _ = _log_probs(w, before[real], x[:steps][real], v)
            np.add.at(out, np.broadcast_to(own, (steps, lanes))[real], logs.astype(np.float64))
            at += count


def _counts(rows: DataFrame) -> DataFrame:
    """(word, cls, n) over the given rows' texts; counted before the shuffle."""

    def run(batches):
        n: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(n), pa.binary()), pa.array([tail_class(w) for w in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "cls", "n"])
            n.clear()
            return out

        for batch in batches:
            for _, texts in text_batches(batch):
                for t in texts:
                    n.update(words_of(t))
                if len(n) > 300_000:
                    yield flush()
        if n:
            yield flush()

    return rows.select("text").mapInArrow(run, "word binary, cls int, n bigint").groupBy("word", "cls").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("w")).first()
    head = counts.orderBy(F.col("n").desc(), "word").limit(HEAD).collect()
    tokens, words = total["n"] + documents, total["w"] + (documents > 0)
    sizes = {r["k"]: r["w"] for r in counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("w")).collect()}
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= FREQUENT:
        least -= 1
        held += sizes.get(least, 0)
    found = counts.where(F.col("n") >= F.lit(float(2**least))).select("word", "n").toArrow()
    frequent = dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))
    frequent |= {bytes(r["word"]): r["n"] for r in head}
    tail = np.zeros((2, TAIL), np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("w")).collect():
        tail[:, r["cls"]] = r["n"], r["w"]
    for r in head:
        tail[:, r["cls"]] -= r["n"], 1
    return Vocabulary([bytes(r["word"]) for r in head], np.array([r["n"] for r in head], np.int64), list(frequent), np.array(list(frequent.values()), np.int64), tail[0], tail[1], tokens, words, documents)


def _tool(shared):
    """A broadcast vocabulary with its lookup tables, kept between a worker's tasks."""
    v = shared.value
    return worker_tool(("lm", id(v)), lambda: (v, *v.lookup()))


def _ids(words: list[bytes], v: Vocabulary, place: Places, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Input ids of the words and the end; places of the frequent words, -1 for others."""
    at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    out = np.empty(len(words) + 1, np.int32)
    out[-1] = v.end
    if len(ids):
        out[:-1] = ids[at]
    for k in np.flatnonzero(at < 0):
        out[k] = v.end + 1 + tail_class(words[k])
    return out, at


def _pack(w: dict) -> bytes:
    return b"".join(w[k].astype("<f4").tobytes() for k in sorted(w))


def _unpack(data: bytes, like: dict) -> dict:
    out, at = {}, 0
    flat = np.frombuffer(data, "<f4")
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def fit(encoded: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict:
    """Weights after ``rounds`` of local training; round r takes the rows (ids, part) of part r, so each is learned from once."""
    spark, w = encoded.sparkSession, first_weights(v)
    shared = spark.sparkContext.broadcast(v)
    groups = max(1, isqrt(max(1, encoded.rdd.getNumPartitions())))
    for r in range(rounds):
        start = spark.sparkContext.broadcast(w)

        def run(batches, start=start):
            docs = [np.frombuffer(x, "<u2") for batch in batches for x in batch.column(0).to_pylist()]
            if docs:
                n = sum(map(len, docs))
                yield pa.record_batch([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([n], pa.int64()), pa.array([_pack(train(start.value, docs, shared.value))], pa.binary())], ["grp", "n", "w"])

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            n = group["n"].sum()
            total = sum(np.frombuffer(x, "<f4").astype(np.float64) * k for x, k in zip(group["w"], group["n"]))
            return pd.DataFrame({"n": [n], "w": [(total / n).astype("<f4").tobytes()]})

        part = encoded.where(F.col("part") == r).select("ids")
        found = part.mapInArrow(run, "grp int, n bigint, w binary").groupBy("grp").applyInPandas(mean, "n bigint, w binary").collect()
        if found:
            n = sum(x["n"] for x in found)
            w = _unpack((sum(np.frombuffer(x["w"], "<f4").astype(np.float64) * x["n"] for x in found) / n).astype("<f4").tobytes(), w)
    return w


def encode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """rid, doc_id, part, n_tokens, n_known, base, share, ids (two bytes each), rare words: a row for each of rows (doc_id, part, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(v)
    end_base, end_known = float(v.base(v.documents)), int(v.documents > 0)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]

    def run(batches):
        vocab, place, ids, base, share = _tool(shared)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in text_batches(batch):
                held, rare, classes, ends = [], [], [np.zeros(0, np.int32)], [0]
                for text in texts:
                    words = words_of(text)
                    x, k = _ids(words, vocab, place, ids)
                    known, unknown = k[k >= 0], np.flatnonzero(k < 0)
                    rare += [words[i] for i in unknown.tolist()]
                    classes.append(x[unknown] - vocab.end - 1)
                    ends.append(len(rare))
                    held.append((rid, len(x), len(known) + end_known, float(base[known].sum()) + end_base, float(share[known].sum()), x.astype("<u2").tobytes()))
                    rid += 1
                rids, *cols = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
                flat = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(np.concatenate(classes), pa.int32())], ["word", "cls"])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.record_batch([rids, batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), *cols], ["rid", "doc_id", "part", "n_tokens", "n_known", "base", "share", "ids", "rare"])

    return rows.mapInArrow(run, f"rid bigint, doc_id {id_type}, part int, n_tokens bigint, n_known bigint, base double, share double, ids binary, rare array<struct<word: binary, cls: int>>")


def score(docs: DataFrame, fold: tuple[int, int] = (10, 0), rounds: int = ROUNDS, pool: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, whole texts.

    Learns from all rows whose id is outside the fold. Null texts are empty: their one token is the end.
    Null ids are scored, neither held out nor learned from; repeated rows give a row each and count
    each; an empty training set gives uniform shares. Other columns are ignored. ``pool`` is the
    number of tokens scored together.
    """
    learned = crc_mod("doc_id", fold[0]) != fold[1]
    rows = docs.select("doc_id", F.when(learned, F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rounds))).cast("int").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    learn = rows.where(learned)
    counts = settle(_counts(learn), "counts")
    v = vocabulary(counts, learn.count())
    encoded = settle(encode(rows, v), "encoded")
    weights = fit(encoded, v, rounds)
    spark = docs.sparkSession
    shared, model = spark.sparkContext.broadcast(v), spark.sparkContext.broadcast(weights)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = Model(model.value, shared.value)
        own, held, size = [], [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            lm = scorer.score(own) / LOG10 + table["share"].to_numpy()
            return table.drop_columns(["share"]).append_column("lm", pa.array(lm, pa.float64())).to_batches()

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("ids"))
            rest, first = batch.drop_columns(["ids"]), 0
            for at, x in enumerate(texts.to_pylist()):
                own.append(np.frombuffer(x, "<u2").astype(np.int32))
                size += len(own[-1])
                if size >= pool:
                    held.append(rest.slice(first, at + 1 - first))
                    yield from flush()
                    own, held, size, first = [], [], 0, at + 1
            if first < len(batch):
                held.append(rest.slice(first))
        if own:
            yield from flush()

    scored = encoded.select("rid", "doc_id", "n_tokens", "n_known", "base", "share", "ids").mapInArrow(run, f"rid bigint, doc_id {id_type}, n_tokens bigint, n_known bigint, base double, lm double")
    # Words too rare for memory meet their counts in a join; the sums go back to the documents.
    rare = encoded.select("rid", F.inline("rare"))
    c = F.coalesce(F.col("c"), F.lit(0))
    floor = F.element_at(F.array(*[F.lit(float(np.log10(a + 0.1 * (b + 1)))) for a, b in zip(v.tail_tokens, v.tail_words)]), F.col("cls") + 1)
    joined = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(c > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.log10(c + 0.1) - F.lit(log10(v.tokens + 0.1 * (v.words + 1)))).alias("rb"),
        F.sum(F.log10(c + 0.1) - floor).alias("rl"),
    )
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.join(sums, "rid", "left").select(
        "doc_id", held_out("doc_id", *fold).alias("held_out"), "n_tokens", (F.col("n_known") + zero("k")).cast("bigint").alias("n_known"),
        F.lit(int(v.tokens)).cast("bigint").alias("train_tokens"), (F.col("base") + zero("rb")).alias("base_score"), (F.col("lm") + zero("rl")).alias("score"),
    )
