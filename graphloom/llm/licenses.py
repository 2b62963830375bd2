"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a sentence or line. A template is found in a block that holds at least the threshold's
share of its distinct words (containment). Words are put in order of their frequency over all
blocks of the corpus, rarest first: a template whose needed overlap is o can only be met by a block
that holds one of its first |T| - o + 1 words (prefix filter), that has o words at least (length
filter), and whose words from the match on leave room for o (positional filter). The rest is
verified, and the words that name the license must be among those found. Line breaks and sentence ends cut notices, so templates are also looked for in stretches of
words across blocks, no longer than the template over the threshold. Fixed phrases are found beside
it, as places of consecutive words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_batches

#: Phrases of the base scan and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, text, words without which the block is about something else) of the templates; a bounded, stated set.
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted software"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "file compliance license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary permitted"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission", "rights reserved reproduced"),
)
_TABLE = bytes((c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))
#: Blocks are cut at ASCII characters only, which never stand within a word.
_BLOCK = re.compile(r"\n+|(?<=[.!?])[ \t-\r]+")


def blocks(text: str) -> list[list[bytes]]:
    """The whole text's blocks as word lists; together they are the text's words in order."""
    return [b.encode("utf-8", "surrogatepass").translate(_TABLE).split() for b in _BLOCK.split(text)]


class TemplateIndex:
    """Templates with words in one global order, indexed by their prefixes."""

    def __init__(self, templates, frequency: dict[bytes, int], threshold: float):
        self.rank = {w: k for k, w in enumerate(sorted(set().union(*(self.words(t) for _, t, _ in templates)), key=lambda w: (frequency.get(w, 0), w)))}
        self.items, self.prefix, self.span = [], {}, []
        for k, (label, text, named) in enumerate(templates):
            words = sorted(self.words(text), key=self.rank.__getitem__)
            if not self.words(named) <= set(words):
                raise ValueError(f"{named!r} is not all in {text!r}")
            need = max(1, ceil(threshold * len(words) - 1e-9))
            self.items.append((label, frozenset(words), need, self.words(named)))
            self.span.append(ceil(len(text.encode().translate(_TABLE).split()) / threshold - 1e-9))
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, at))
        self.first = frozenset(self.prefix)

    @staticmethod
    def words(text: str) -> frozenset[bytes]:
        return frozenset(text.encode().translate(_TABLE).split())

    def find(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of all templates that the block meets."""
        if self.first.isdisjoint(words):
            return []
        held = set(words)
        known = sorted((w for w in held if w in self.rank), key=self.rank.__getitem__)
        tried, out = set(), []
        for place, w in enumerate(known):
            for k, at in self.prefix.get(w, ()):
                _, whole, need, named = self.items[k]
                if k in tried or len(held) < need or min(len(whole) - at, len(known) - place) < need:
                    continue
                tried.add(k)
                both = len(whole & held)
                if both >= need and named <= held:
                    out.append((k, both / len(whole)))
        return out

    def stretches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, containment) of the best among overlapping stretches that meet a template."""
        held, out = set(words), []
        if self.first.isdisjoint(held):
            return out
        for k, (_, whole, need, named) in enumerate(self.items):
            if len(whole & held) < need or not named <= held:
                continue
            at, a, count, last = [i for i, w in enumerate(words) if w in whole], 0, Counter(), None
            for i in at:
                count[words[i]] += 1
                while i - at[a] >= self.span[k] or count[words[at[a]]] > 1:
                    w = words[at[a]]
                    count[w] -= 1
                    if not count[w]:
                        del count[w]
                    a += 1
                if len(count) < need or not named <= count.keys():
                    continue
                found = (k, at[a], i, len(count) / len(whole))
                if last is None or found[1] > last[2]:
                    out.append(found)
                elif found[3] > last[3]:
                    out[-1] = found
                last = out[-1]
        return out


def _frequencies(rows: DataFrame, templates) -> dict[bytes, int]:
    """In how many of the corpus's blocks each template word stands; no more rows than template words."""
    vocabulary = frozenset().union(*(TemplateIndex.words(t) for _, t, _ in templates))

    def run(batches):
        for batch in batches:
            n: Counter = Counter()
            for _, texts in text_batches(batch):
                for t in texts:
                    for words in blocks(t):
                        n.update(vocabulary.intersection(words))
            yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return {bytes(r["word"]): r["n"] for r in rows.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _places(words: list[bytes], phrases: list[list[bytes]]) -> list[list[int]]:
    """By phrase: all places where its words stand one after another."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase in phrases:
        look, at, found, seen, count = b" " + b" ".join(phrase) + b" ", -1, [], 0, 0
        while (at := line.find(look, at + 1)) >= 0:
            count += line.count(b" ", seen, at)
            seen = at
            found.append(count)
        out.append(found)
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``blocks`` lists every block that meets a template (block, template, containment), and by their
    first block the stretches across blocks that meet one better. All templates met give their labels,
    except where the words found are among those of another template met there that has more of
    them or, having the same, is met better. ``score`` is
    the largest containment, 1 where a phrase stands, else 0. Null and empty texts have no words,
    no labels (empty strings) and score 0; null ids and repeated rows give rows like others; an empty table gives no rows; other
    columns are ignored. Two passes (frequencies, join), no shuffle of texts.
    """
    phrases = PHRASES if phrases is None else phrases
    split = [p.encode().translate(_TABLE).split() for p in phrases]
    names = list(phrases.values())
    rows = docs.select("doc_id", "text")
    index = TemplateIndex(templates, _frequencies(rows, templates), threshold)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("block", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(hit)]
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def one(text: str) -> tuple:
        cut = blocks(text)
        words = [w for b in cut for w in b]
        places = _places(words, split)
        every = sorted(p for found in places for p in found)
        base = {n for n, found in zip(names, places) if found}
        hits = [(k, t, c) for k, b in enumerate(cut) for t, c in index.find(b)]
        starts = list(accumulate(map(len, cut), initial=0))
        met = [(starts[k], starts[k + 1] - 1, t, c, index.items[t][1].intersection(cut[k])) for k, t, c in hits]
        for t, a, z, c in index.stretches(words):
            k, end = bisect_right(starts, a) - 1, bisect_right(starts, z) - 1
            if k < end and all(x != t or y < a or b > z or d < c for b, y, x, d, _ in met):
                hits.append((k, t, c))
                met.append((a, z, t, c, index.items[t][1].intersection(words[a : z + 1])))
        hits.sort()
        labels = base | {templates[t][0] for a, z, t, c, found in met if not any(b <= z and a <= y and (found < more or found == more and c < d) for b, y, _, d, more in met)}
        score = 1.0 if base else max((c for _, _, c in hits), default=0.0)
        return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"block": k, "template": t, "containment": c} for k, t, c in hits]

    def run(batches):
        for batch in batches:
            found = list(zip(*(one(t) for _, texts in text_batches(batch) for t in texts))) or [[]] * len(columns)
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(found, kinds))], ["doc_id", *columns])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<block: bigint, template: int, containment: double>>")
