"""Language identification by segmentation-marginalised unigrams.

Over a fixed public vocabulary of word pieces each language has a unigram distribution. A word's
probability is the sum, by the forward algorithm, over all its segmentations into pieces; a text's
is the product over its words. Pieces never cross white space, so words are scored once and cached.
Characters outside the vocabulary fall back to byte pieces: every text has a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CACHE_ENTRIES, bounded_batches, crc_mod, held_out, release, worker_tool

_LETTER = re.compile(r"[^\W\d_]")
RESULT = "lang_pred string, score double"


@lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def vocabulary(path: str) -> dict[str, int]:
    """Piece to index, byte pieces included; control pieces are left out."""
    sp = _processor(path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))}


class Pieces:
    """Finds every piece at every place of many words at once, by a rolling hash over code points."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.longest = max((len(p) for p in pieces if not p.startswith("<0x")), default=1)
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(pieces) if p.startswith("<0x")}
        found = {}
        for k, p in enumerate(pieces):
            if not p.startswith("<0x"):
                h = 0
                for c in p:
                    h = (h * int(self._BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                found[h] = k
        self.hashes = np.array(sorted(found), np.uint64)
        self.ids = np.array([found[int(h)] for h in self.hashes], np.int64)
        self.shift = np.uint64(44)
        starts = self._mix(self.hashes)
        self.order = np.argsort(starts, kind="stable")
        self.first = np.searchsorted(starts[self.order], np.arange((1 << 20) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max(initial=0))

    def _mix(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece index per hash, -1 where it is no piece."""
        out = np.full(h.shape, -1, np.int64)
        at = self._mix(h)
        lo, hi = self.first[at], self.first[at + np.uint64(1)]
        for k in range(self.most):
            live = lo + k < hi
            if not live.any():
                break
            place = self.order[np.minimum(lo + k, len(self.order) - 1)]
            hit = live & (self.hashes[place] == h)
            out[hit] = self.ids[place[hit]]
        return out

    def lattice(self, words: list[str]):
        """(lengths, codes, by piece length d: piece index starting at each place, or -1), a space mark before each word."""
        sizes = np.array([len(w) + 1 for w in words])
        codes = np.zeros((len(words), int(sizes.max())), np.uint64)
        flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
        out, h = [], np.zeros_like(codes)
        for d in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - d + 1] * self._BASE + codes[:, d - 1 :]
            ids = self.find(h)
            ids[codes[:, d - 1 :] == 0] = -1
            out.append(ids)
        return sizes, codes, out

    def odd(self, words: list[str], lattice, prob: np.ndarray) -> np.ndarray:
        """By place: the product of the bytes' probabilities of a character that is no piece, else 0."""
        out = np.zeros(lattice[0].shape)
        for r, w in enumerate(words):
            for j in np.flatnonzero(lattice[0][r, : len(w) + 1] < 0):
                out[r, j] = np.prod([prob[self.byte_ids[b]] for b in ("▁" + w)[j].encode("utf-8", "surrogatepass")])
        return out


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(list(vocabulary(path)))


#: Probabilities below 1 / SCALE are multiplied by SCALE and the turn is remembered.
SCALE = 1e100


def _forward(table: np.ndarray, finder: Pieces, words: list[str]):
    """(log probability of each word per column of ``table`` (pieces x languages), all segmentations summed; sizes; lattice; alpha; turns).

    ``alpha[j]`` of a word is scaled up by SCALE as often as ``turns[j]`` says.
    """
    sizes, codes, lattice = finder.lattice(words)
    n, m, width, longest = len(words), codes.shape[1], table.shape[1], len(lattice)
    alpha, turns = np.zeros((m + 1, n, width)), np.zeros((m + 1, n))
    alpha[0] = 1.0
    padded = np.vstack([table, np.zeros((1, width))])
    # characters that are no piece: the product of their bytes' pieces
    odd = (lattice[0] < 0) & (codes > 0)
    single = {int(c): np.prod([table[finder.byte_ids[b]] for b in chr(int(c)).encode("utf-8", "surrogatepass")], axis=0) for c in np.unique(codes[odd])}
    out = np.zeros((n, width))
    for j in range(1, m + 1):
        turns[j] = turns[j - 1]
        for d in range(1, min(j, longest) + 1):
            p = padded[lattice[d - 1][:, j - d]]
            if d == 1 and odd[:, j - 1].any():
                for r in np.flatnonzero(odd[:, j - 1]):
                    p[r] = single[int(codes[r, j - 1])]
            alpha[j] += alpha[j - d] * p
        if j % 4 == 0:
            # a word's last columns keep one scale, as the next ones are made of them
            first = max(0, j - longest + 1)
            low = (alpha[first : j + 1].max(axis=(0, 2)) < 1 / SCALE) & (sizes >= j)
            if low.any():
                alpha[first : j + 1, low] *= SCALE
                turns[first : j + 1, low] += 1
        done = sizes == j
        if done.any():
            with np.errstate(divide="ignore"):
                out[done] = np.maximum(np.log(alpha[j][done]), -745.0) - turns[j][done, None] * np.log(SCALE)
    return out, sizes, lattice, alpha, turns


def _by_length(words: list[str], most: int = 4096):
    """Slices of places whose words have nearly the same length, so that little is padded."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        size = len(words[order[at]])
        end = at
        while end < len(order) and end - at < max(1, most * 16 // (size + 16)) and len(words[order[end]]) <= size + 1:
            end += 1
        yield order[at:end]
        at = end


def word_log_probs(table: np.ndarray, finder: Pieces, words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]))
    for part in _by_length(words):
        out[part] = _forward(table, finder, [words[k] for k in part])[0]
    return out


def _expected(words: Counter, prob: np.ndarray, finder: Pieces) -> np.ndarray:
    """Expected piece counts of one language: forward and backward over all segmentations of all words, of any length.

    The bytes of characters that are no piece are not counted here.
    """
    todo = list(words)
    out, padded = np.zeros(len(prob) + 1), np.append(prob, 0.0)
    for part in _by_length(todo):
        own = [todo[k] for k in part]
        _, sizes, lattice, alpha, turns = _forward(prob[:, None], finder, own)
        alpha, n, m, longest, every = alpha[:, :, 0], len(own), alpha.shape[0] - 1, len(lattice), np.arange(len(own))
        odd = finder.odd(own, lattice, prob)
        beta, back = np.zeros((m + 1, n)), np.zeros((m + 1, n))
        beta[sizes, every] = 1.0
        for i in range(m - 1, -1, -1):
            back[i] = np.where(i < sizes, back[i + 1], 0.0)
            for d in range(1, min(m - i, longest) + 1):
                p = padded[lattice[d - 1][:, i]]
                if d == 1:
                    p = np.where(odd[:, i] > 0, odd[:, i], p)
                beta[i] += p * beta[i + d]
            if i % 4 == 0:
                last = min(m, i + longest - 1)
                low = (beta[i : last + 1].max(axis=0) < 1 / SCALE) & (sizes > i)
                if low.any():
                    beta[i : last + 1, low] *= SCALE
                    back[i : last + 1, low] += 1
        total, turned = alpha[sizes, every], turns[sizes, every]
        weight = np.where(total > 0, np.array([words[w] for w in own]) / np.where(total > 0, total, 1.0), 0.0)
        for i in range(m):
            for d in range(1, min(m - i, longest) + 1):
                ids = lattice[d - 1][:, i]
                if (ids < 0).all():
                    continue
                rest = np.clip(turned - turns[i] - back[i + d], -3, 3)
                share = alpha[i] * SCALE ** np.minimum(rest, 0) * padded[ids] * beta[i + d] * SCALE ** np.maximum(rest, 0) * weight
                out += np.bincount(np.where(ids < 0, len(prob), ids), share, len(out))
    return out[:-1]


@dataclass(frozen=True, eq=False)
class LanguageModel:
    """Languages in order; piece probabilities, pieces x languages; the vocabulary's path on every worker."""

    languages: tuple[str, ...]
    table: np.ndarray
    path: str


class WordScorer:
    """Languages of texts; a word's log probabilities are kept once found."""

    def __init__(self, model: LanguageModel):
        self.model, self.finder = model, pieces_of(model.path)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [t.lower().split() if t and self.model.languages and _LETTER.search(t) else [] for t in texts]
        seen = set().union(*split)
        new = [w for w in seen if w not in self.known]
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known, self.rows, new = {}, self.rows[:0], list(seen)
        if new:
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.vstack([self.rows, word_log_probs(self.model.table, self.finder, new)])
        get, out = self.known.__getitem__, []
        for words in split:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.rows[list(map(get, words))].sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(np.maximum(-700.0, total - total[best])).sum())))
        return out


def fit_words(words: dict[str, Counter], vocabulary_path: str, rounds: int = 1, smooth: float = 0.02) -> LanguageModel:
    """Piece distributions from word counts by language: start at the library's segmentation, then EM."""
    vocab, sp, finder = list(vocabulary(vocabulary_path)), _processor(vocabulary_path), pieces_of(vocabulary_path)
    place = {sp.piece_to_id(p): k for k, p in enumerate(vocab)}
    languages, columns = tuple(sorted(words)), []
    for lang in languages:
        todo = list(words[lang])
        counts = np.zeros(len(vocab))
        for word, pieces in zip(todo, sp.encode(todo, num_threads=1) if todo else []):
            for p in pieces:
                if p in place:
                    counts[place[p]] += words[lang][word]
        bytes_only = np.zeros(len(vocab))
        at = list(finder.byte_ids.values())
        bytes_only[at] = counts[at]
        for step in range(rounds + 1):
            prob = (counts + smooth) / (counts.sum() + smooth * len(vocab))
            if step < rounds:
                counts = _expected(words[lang], prob, finder) + bytes_only
        columns.append(prob)
    return LanguageModel(languages, np.stack(columns, 1) if columns else np.zeros((len(vocab), 0)), vocabulary_path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fit(docs: DataFrame, vocabulary_path: str | None = None, docs_per_language: int = 300, fold: tuple[int, int] = (3, 1)) -> LanguageModel:
    """Fit on about ``docs_per_language`` labelled documents of each language, outside the held-out fold.

    The sample is drawn by the id's hash with a rate from the language's count; rows with null text,
    lang or id are not learned from. Texts are used whole.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", fold[0]) != fold[1]))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    words: dict[str, Counter] = {k: Counter() for k in sizes}
    if sizes:
        rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, docs_per_language / n)))])
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1e6)
        for r in labelled.where(place < rate[F.col("lang")]).select("lang", "text").toLocalIterator():
            words[r["lang"]].update(r["text"].lower().split())
    model = fit_words({k: c for k, c in words.items() if c}, vocabulary_path or default_vocabulary())
    del words
    release()
    return model


def predictor(df: DataFrame, model: LanguageModel, text: str | Column = "text") -> Column:
    """Column struct<lang_pred, score> for a text column. The model's size is bounded by its vocabulary."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        scorer, found = worker_tool(("langid", id(model)), lambda: WordScorer(model)), []
        for at in range(0, len(texts), 512):
            found += scorer.predict(list(texts[at : at + 512]))
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, model: LanguageModel | None = None, fold: tuple[int, int] = (3, 1)) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, whole texts.

    ``und`` with score 0 for null text, text without a letter, or a model without languages (an
    empty table). Null ids are scored, not held out. Repeated rows give a row each; other columns
    of the input are ignored.
    """
    model = model or fit(docs, fold=fold)
    rows = docs.select(F.col("doc_id"), F.col("text"))
    out = rows.select("doc_id", held_out("doc_id", *fold).alias("held_out"), predictor(rows, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
