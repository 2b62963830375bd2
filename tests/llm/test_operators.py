"""Each operator against a brute-force version, on small fixtures with nulls, empties, repeats and extra columns."""

import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import decontaminate, langid, licenses, lm, minhash, packing, quality, tokens, toxicity, vectors
from graphloom.llm.common import text_batches  # noqa: F401
from graphloom.llm.components import components

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """documents with an extra column whose name an operator also returns."""
    return spark.createDataFrame([(i, t, None, "s", 1.0) for i, t in rows], "doc_id bigint, text string, lang string, source string, score double")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    near = base[3].split()
    for k in range(12):  # a chain of near copies, exact copies, and a long text
        near[rng.randrange(len(near))] = rng.choice(WORDS)
        out.append((100 + k, " ".join(near)))
    out += [(200, base[5]), (201, base[5].upper()), (202, None), (203, ""), (204, " \t\n"), (205, "one two"), (206, "One  TWO"), (207, prose(rng, 9000)), (None, base[5]), (208, base[5]), (208, base[5])]
    return out


# near-duplicates ----------------------------------------------------------------------------------
def _components(rows, width, percent):
    """Brute force: (id, set size) of each row, and each id's smallest reachable id."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            k = min(width, len(w))
            sets[i].append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in set(sets[a]) for y in set(sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i in sets for s in sets[i])


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, rows, width):
    got = minhash.near_duplicates(frame(spark, rows), width=width, percent=80).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == _components(rows, width, 80)
    assert all(r["kept"] == (r["component_id"] in (None, r["doc_id"])) and (r["component_id"] is None) == (r["doc_id"] is None) for r in got)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_around_the_threshold(spark):
    """All links at 0.80 to 0.85 are found, none below; a bucket of many classes; an id with several texts."""
    rng, docs = random.Random(31), []
    for k in range(60):
        words = prose(rng, 150).split()
        docs.append((10 * k, " ".join(words)))
        for j in range(1, 5):
            copy = list(words)
            for at in range(2 + j):  # each changed word costs four or five shingles: similarity 0.85 to 0.7
                copy[7 + 20 * at] = f"changed{k}x{j}x{at}"
            docs.append((10 * k + j, " ".join(copy)))
    a, b = prose(rng, 40), prose(rng, 40)
    docs += [(2005, a), (2007, a), (2007, b), (2009, b)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), width=5, percent=80).collect()
    want = _components(docs, 5, 80)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert 60 < sum(c != i for i, _, c in want) < 240
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] > 2000} == {(2005, 2005, True), (2007, 2005, False), (2009, 2005, False)}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        assert minhash.sketch(a).shape == (minhash.BINS,)
    diffs = []
    for _ in range(30):
        x = rng.integers(0, 1 << 62, 900).astype(np.uint64)
        a, b = np.unique(x[:800]), np.unique(x[100:])
        diffs.append((minhash.sketch(a) == minhash.sketch(b)).mean() - 700 / 900)
    assert abs(np.mean(diffs)) < 0.02


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(500, 500 + k) for k in range(1, 30)] + [(7, 7), (700, 701), (701, 700)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {500 + k: 500 for k in range(30)} | {700: 700, 701: 700}


# toxicity -----------------------------------------------------------------------------------------
def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["zorkily", "glumfest", "vexopram"]
    docs, labels = [], []
    for i in range(600):
        words, toxic = prose(rng, 60).split(), i % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (1001, ""), (None, "zorkily")]
    out = toxicity.classify(frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held)
    assert right > 0.95
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    none = toxicity.classify(frame(spark, docs[:5]), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["predicted"] for r in none.collect()} == {0}


# decontamination ----------------------------------------------------------------------------------
def _leaks(docs, items, width=5, percent=80):
    import re

    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for i, t in docs:
        for j, b in items:
            if i is None or not t or not b or not cut(b):
                continue
            w, m = cut(t), cut(b)
            k = min(width, len(m))
            grams = lambda x: [tuple(x[p : p + k]) for p in range(len(x) - k + 1)]
            d, g = grams(w), Counter(grams(m))
            n = sum(g.values())
            for s in range(len(d) - n + 1):
                both = sum((Counter(d[s : s + n]) & g).values())
                if both and 100 * both >= percent * (2 * n - both):
                    sim = both / (2 * n - both)
                    if sim > out.get((i, j), (0, 0))[0]:
                        out[i, j] = (sim, s)
    return out


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate((30, 45, 30, 12, 3))] + [(90, None), (91, ""), (92, "!!")]
    docs = [(i, prose(rng, 120)) for i in range(12)]
    for i, (j, edits) in enumerate([(0, 0), (1, 1), (2, 2), (3, 0), (4, 0), (0, 12)]):
        words = items[j][1].split()
        for k in range(edits):  # the first edit is at the passage's start, where it costs one shingle
            words[rng.randrange(len(words)) if k else 0] = "changed"
        docs.append((50 + i, prose(rng, 30) + " " + " ".join(words).upper() + ", " + prose(rng, 30)))
    docs += [(75, items[0][1]), (75, prose(rng, 40) + " " + items[1][1]), (70, items[0][1]), (70, items[0][1]), (71, None), (72, ""), (None, items[0][1]), (73, items[1][1] + " " + items[1][1]), (74, prose(rng, 8000) + " " + items[2][1])]
    got = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    want = _leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["first_word"]) for r in got.collect()} == {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()}
    assert (50, 0) in want and (51, 1) in want
    assert decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_documents_shorter_than_an_item(spark):
    item = prose(random.Random(13), 60).split()
    docs = [(1, " ".join(item[:54])), (2, " ".join(item[1:])), (3, " ".join(item[:40])), (4, " ".join(item[:49])), (5, " ".join(item[:48])), (6, " ".join(item)), (7, prose(random.Random(14), 55))]
    got = decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame([(0, " ".join(item))], "item_id bigint, text string"))
    want = {1: 50 / 56, 2: 55 / 56, 4: 45 / 56, 6: 1.0}  # 48 words hold 44 of 56 shingles, less than 80 %
    assert {r["doc_id"]: (r["similarity"], r["first_word"]) for r in got.collect()} == {k: (pytest.approx(x), 0) for k, x in want.items()}


# licenses -----------------------------------------------------------------------------------------
def test_license_scan(spark):
    texts = ["Released under the MIT License.\nmore words", "gnu GENERAL public license, then cc by cc by", "Licensed under CC BY-NC 4.0. Fine.", None, "", "mit licensed", "word " * 5000 + "apache license", "x under released the LICENSE mit y"]
    out = {r["doc_id"]: r for r in licenses.scan(frame(spark, list(enumerate(texts)) + [(0, texts[0])])).collect()}
    assert (out[0]["base_labels"], out[0]["first_word"], out[0]["last_word"], out[0]["n_words"]) == ("mit", 3, 3, 7)
    assert (out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (3, 0, 7, "cc-by,gpl")
    assert out[2]["labels"] == "cc-by,cc-by-nc"
    assert out[3]["n_words"] == out[4]["n_words"] == 0 and out[3]["labels"] == "" and out[3]["first_word"] is None
    assert out[5]["n_base"] == 0
    assert (out[6]["first_word"], out[6]["labels"]) == (5000, "apache")
    assert (out[7]["base_labels"], out[7]["labels"], out[7]["score"]) == ("", "mit", 1.0)


def test_wrapped_license_notices(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
        "All rights reserved. No part of this publication may be reproduced without permission.",
        "x\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that",
        "This Source Code Form is subject to the terms of the Mozilla Public\n License, v. 2.0. If a copy",
        "you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published",
        "Released under\n" + "the word\n" * 40 + "MIT license here",
    ]
    out = {r["doc_id"]: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert [out[k]["labels"] for k in range(7)] == ["mit", "proprietary", "apache", "bsd", "mpl", "lgpl", "mit"]
    assert [b["block"] for b in out[2]["blocks"]] == [1] and out[1]["score"] == 1.0 and not out[6]["blocks"]


def test_all_licenses_of_a_block_are_labelled(spark):
    texts = [
        "this is free and unencumbered software released into the public domain and this source code form is subject to the terms of the mozilla public license v 2 0",
        "Licensed under CC BY-SA 4.0",
        "licensed under the gnu affero general public license",
    ]
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(frame(spark, list(enumerate(texts))), phrases={}).collect()}
    assert out == {0: "mpl,public-domain", 1: "cc-by-sa", 2: "agpl"}


def test_a_label_needs_the_words_that_name_the_license(spark):
    texts = ["Licensed under the GNU General Public License.", "Released under the Apache License.", "Released under the BSD license.", "Released under the MIT license.", "Released under the license."]
    out = {r["doc_id"]: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert [out[k]["labels"] for k in range(5)] == ["gpl", "apache", "bsd", "mit", ""] and out[4]["score"] == 0


def _base_scan(text):
    """Brute force of the contract's columns."""
    import re

    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    found = {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        found.setdefault(label, []).extend(k for k in range(len(words)) if words[k : k + len(p)] == p)
    at = sorted(k for v in found.values() for k in v)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(k for k, v in found.items() if v))


def test_base_scan_against_brute_force(spark):
    rng = random.Random(15)
    parts = ["mit", "license", "Apache", "GNU", "general", "public", "CC", "by", "x", "été", "7"]
    gaps = [" ", " ", "\n", ". ", "!\u3000", ".\u00a0", "?\u0085", ". \u00a0 ", ".\u2003", "-", "\t", ".\u001c", "\x00"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["mit. \u00a0 license", "a!\u3000b", None, "", "é" * 50_000 + " mit license"]
    out = {r["doc_id"]: r for r in licenses.scan(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == _base_scan(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_license_join_is_exact():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(30)]
    templates = [(str(k), " ".join(rng.sample(vocabulary, rng.randrange(1, 12))), "") for k in range(25)]
    index = licenses.TemplateIndex(templates, {w.encode(): rng.randrange(100) for w in vocabulary}, 0.7)
    for _ in range(300):
        block = [w.encode() for w in rng.choices(vocabulary, k=rng.randrange(0, 20))]
        want = {k for k, (_, t, _) in enumerate(templates) if len(set(t.encode().split()) & set(block)) >= 0.7 * len(set(t.split())) - 1e-9 and set(t.encode().split()) & set(block)}
        assert {k for k, _ in index.find(block)} == want


# language -----------------------------------------------------------------------------------------
def test_segmentations_are_summed():
    path = langid.default_vocabulary()
    model = langid.fit_words({"a": Counter(["hello", "world"] * 3), "b": Counter(["monde", "été"] * 3)}, path)
    at = {p: k for k, p in enumerate(langid.vocabulary(path))}

    def plain(word):
        s, alpha = "▁" + word, [np.ones(2)]
        for j in range(1, len(s) + 1):
            total = np.zeros(2)
            for i in range(j):
                if s[i:j] in at:
                    total = total + alpha[i] * model.table[at[s[i:j]]]
                elif i == j - 1:
                    total = total + alpha[i] * np.prod([model.table[at[f"<0x{b:02X}>"]] for b in s[i].encode()], axis=0)
            alpha.append(total)
        return np.log(alpha[-1])

    words = ["hello", "monde", "日本🙂", "a", "x" * 50]
    got = langid.word_log_probs(model.table, langid.pieces_of(path), words)
    for w, g in zip(words, got):
        assert g == pytest.approx(plain(w))
    assert np.isfinite(langid.word_log_probs(model.table, langid.pieces_of(path), ["ab" * 3000])).all()


def test_language_identification(spark):
    rng = random.Random(8)
    kinds = {"x": ["kolo", "mira", "tesa", "luno"], "y": ["schraf", "ungen", "keit", "brunst"]}
    docs = [(i, " ".join(rng.choices(kinds["xy"[i % 2]], k=20)), "xy"[i % 2]) for i in range(120)] + [(500, None, "x"), (501, "123 !?", "y"), (502, "kolo mira", None), (None, "keit", "y")]
    out = langid.identify(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(docs)
    assert all(by[i]["lang_pred"] == "xy"[i % 2] and 0.5 < by[i]["score"] <= 1 for i in range(120))
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[502]["lang_pred"] == "x" and by[None]["lang_pred"] == "y"
    unlabelled = spark.createDataFrame([(1, "kolo", None)], "doc_id bigint, text string, lang string")
    assert langid.identify(unlabelled).first()["lang_pred"] == "und"


# embeddings ---------------------------------------------------------------------------------------
def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = list(rng.normal(size=(300, 32)))
    for k in range(0, 60):
        x.append(x[k % 12] + 0.05 * rng.normal(size=32))
    x += [x[0].copy(), x[0].copy(), 2.5 * x[1]]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] * 32, 0), (1003, [None] + [1.0] * 31, 0), (1004, [1.0, 2.0], 0), (1005, [], 0), (None, rows[0][1], 0)]
    m = np.array(x)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links int"), block=16).collect()}
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(n)] == linked.sum(1).tolist()
    part = np.arange(n)
    for _ in range(n):
        new = np.array([min([part[i], *part[linked[i]]]) for i in range(n)])
        if (new == part).all():
            break
        part = new
    assert [got[i]["component_id"] for i in range(n)] == part.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1000, 1006)) and got[None]["kept"]


def test_hashing_recall_just_above_the_threshold():
    rng = np.random.default_rng(3)
    for d, hashes in ((32, 3), (64, 3), (64, 4), (384, 3)):
        x, z = rng.normal(size=(2, 400, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        cosine = rng.uniform(0.95, 0.97, (400, 1))
        y = cosine * x + np.sqrt(1 - cosine**2) * z
        a, b = (vectors.bucket_keys(v, 14, hashes).reshape(400, 14, vectors.PROBES) for v in (x, y))
        assert ((a[:, :, :1] == b).any((1, 2)) | (b[:, :, :1] == a).any((1, 2))).mean() >= 0.93


def test_links_near_the_threshold_against_brute_force(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 48))
    y = x[:300] + rng.uniform(0.2, 0.4, (300, 1)) * rng.normal(size=(300, 48))
    crowd = x[7] + 0.03 * rng.normal(size=(120, 48))  # one bucket of many, in blocks
    m = np.vstack([x, y, crowd]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>")
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = u @ u.T >= 0.95
    np.fill_diagonal(want, False)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(rows, block=32).collect()}
    found = np.array([got[i] for i in range(len(m))])
    assert (found <= want.sum(1)).all() and found.sum() >= 0.97 * want.sum() and found[:300].sum() >= 0.95 * want[:300].sum() and want[:400, 400:700].sum() > 60
    assert vectors.near_vectors(rows.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), 16 * x)


# tokens -------------------------------------------------------------------------------------------
ODD = ["", "a  b\n\n c", "  lead", "tab\t x's don't  \n y", "é́ x\u0085y", "<|endoftext|> hi<|endoftext|>", "a\x1cb", "日本語 テスト 123 45", "ΑΣ ΑΣΑ", "x y z", "İstanbul 'LL", "<| x |>", "\r\n a \n b", "🙂🙂 🙂", "The THE straße"]


def test_token_counts(spark, rows):
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    library = Tokenizer.from_file(path)
    texts = [*rows, *[(300 + k, t) for k, t in enumerate(ODD)]]
    got = tokens.count_tokens(frame(spark, texts)).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_packing_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(i, t) for i, t in rows if i not in (208, None)] + [(300 + k, t) for k, t in enumerate(ODD)]
    pieces = packing.pack(frame(spark, texts).repartition(3), size=256, open_windows=4).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts}
    by = defaultdict(list)
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by[r["doc_id"]].append((r["start"], r["length"]))
    for i, found in by.items():
        at = 0
        for start, length in sorted(found):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    assert set(by) == set(ids)
    windows = defaultdict(list)
    for r in pieces:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0 and at < 256
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


# quality ------------------------------------------------------------------------------------------
def test_resampling(spark):
    rng = random.Random(12)
    docs = [(i, prose(rng, 40) if i % 4 else " ".join(w + "%%%" for w in prose(rng, 40).split())) for i in range(400)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    out = quality.resample(frame(spark, docs), labels, fraction=0.7).collect()
    assert len(out) == len(docs) and sum(r["selected"] for r in out) == -int(-0.7 * len(docs) // 1)
    worst = min(r["key"] for r in out if r["selected"])
    assert all(r["selected"] == (r["key"] >= worst) for r in out)
    good = [r["log_weight"] for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4]
    junk = [r["log_weight"] for r in out if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    assert min(good) > max(junk)
    same = frame(spark, [(7, "same text here")] * 20)
    assert quality.resample(same, labels.limit(0), fraction=0.5).where("selected").count() == 10


# language model -----------------------------------------------------------------------------------
def test_gradients():
    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 4, 3]), [b"a", b"b", b"c"], np.array([5, 4, 3]), np.full(lm.TAIL, 2), np.full(lm.TAIL, 1), 20, 10, 4)
    w = {k: x.astype(np.float64) for k, x in lm.first_weights(v, hidden=4).items()}
    rng = np.random.default_rng(0)
    ids, h = rng.integers(0, v.inputs, 30), rng.normal(size=(30, 4))
    grads = {k: np.zeros_like(x) for k, x in w.items()}
    _, dh = lm._log_probs(w, h, ids, v, grads)
    loss = lambda: -lm._log_probs(w, h, ids, v)[0].sum()
    for name, at in (("Wc", (1, 2)), ("bc", (0,)), ("Wo", (2, 1)), ("bo", (1,))):
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(grads[name][at], abs=1e-4)
        w[name][at] += 1e-5
    h[3, 1] += 1e-5
    up = loss()
    h[3, 1] -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(dh[3, 1], abs=1e-4)


def test_gradients_of_the_recurrent_part():
    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 4, 3]), [b"a", b"b", b"c"], np.array([5, 4, 3]), np.full(lm.TAIL, 2), np.full(lm.TAIL, 1), 20, 10, 4)
    rng = np.random.default_rng(2)
    w = {k: x.astype(np.float64) + 0.1 * rng.normal(size=x.shape) for k, x in lm.first_weights(v, hidden=5).items()}
    x, h = rng.integers(0, v.inputs, (3, 7)).astype(np.int32), 0.3 * rng.normal(size=(3, 5))
    x[0, 2] = x[1, 4] = v.end  # the state starts anew
    real = np.ones((3, 7), bool)
    real[2, 5:] = False
    loss = lambda: lm.window_gradients(w, x, real, h, v)[0]
    grads = lm.window_gradients(w, x, real, h, v)[1]
    for name in ("E", "Wx", "U", "b", "Wc", "Wo", "bc", "bo"):
        places = [tuple(rng.integers(0, s) for s in w[name].shape) for _ in range(12)]
        places += [(int(x[r, c]), 1) for r, c in ((0, 0), (0, 2), (1, 3), (2, 5))] if name == "E" else []
        for at in places:
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = loss()
            w[name][at] = old - 1e-5
            down = loss()
            w[name][at] = old
            assert (up - down) / 2e-5 == pytest.approx(grads[name][at], abs=2e-5), (name, at)


def test_held_out_documents_score_better_than_the_base(spark):
    rng = random.Random(21)
    after = {w: rng.sample(WORDS[:60], 4) for w in WORDS[:60]}
    docs = []
    for i in range(400):
        words = [rng.choice(WORDS[:60])]
        while len(words) < 120:
            words.append(rng.choice(after[words[-1]]))
        docs.append((i, " ".join(words)))
    out = [r for r in lm.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in out)
    gain = sum(r["score"] - r["base_score"] for r in out) / tokens
    assert len(out) > 20 and gain > 0.3  # log10 a token; the order of words is worth 1.2 at most


def test_state_is_carried_and_shares_sum_to_one():
    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 4, 3]), [b"a", b"b", b"c"], np.array([5, 4, 3]), np.full(lm.TAIL, 2), np.full(lm.TAIL, 1), 20, 10, 4)
    w = lm.first_weights(v, hidden=4)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, v.inputs, n).astype(np.int32) for n in (1, 5, 200, 64, 65, 3)]
    whole = lm.Model(w, v, lanes=1, window=1000).score(docs)
    assert lm.Model(w, v, lanes=3, window=7).score(docs) == pytest.approx(whole, rel=1e-4)
    first = [np.exp(lm.Model(w, v).score([np.array([k], np.int32)])[0]) for k in range(v.inputs)]
    assert sum(first) == pytest.approx(1, abs=1e-4)
    better = lm.train(w, [np.tile(np.array([0, 1, 2], np.int32), 400)], v)
    assert lm.Model(better, v).score([np.tile(np.array([0, 1, 2], np.int32), 20)])[0] > lm.Model(w, v).score([np.tile(np.array([0, 1, 2], np.int32), 20)])[0]


@pytest.mark.parametrize("head,frequent", [(lm.HEAD, lm.FREQUENT), (16, 40)])  # the latter: most words meet their counts in a join
def test_scores(spark, rows, monkeypatch, head, frequent):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    out = lm.score(frame(spark, rows)).collect()
    learn = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in learn for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    base = lambda c: log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for i, t in rows:
        words = (t or "").encode().lower().split()
        want[i, len(words) + 1, 1 + sum(w in counts for w in words), round(sum(base(counts[w]) for w in words) + base(len(learn)), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    empty = lm.score(frame(spark, rows).limit(0))
    assert empty.count() == 0


def test_every_training_document_is_learned_from(spark):
    docs = [(i, " ".join(["kolo mira tesa"] * 300)) for i in range(1, 9)]
    rows = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    late = spark.createDataFrame(rows, "doc_id bigint, text string").where("pmod(xxhash64(doc_id, 3), 32) > 2")
    assert late.count() > 0
    out = lm.score(frame(spark, [(r["doc_id"], r["text"]) for r in late.collect()])).collect()
    assert all(r["score"] > 0.8 * r["base_score"] for r in out)  # the words' order is learned
    encoded = lm.encode(late.selectExpr("doc_id", "cast(pmod(doc_id, 4) as int) part", "text"), lm.vocabulary(lm._counts(late), late.count()))
    assert sorted(r["doc_id"] for r in encoded.collect()) == sorted(r["doc_id"] for r in late.collect())


def test_training_takes_the_end_of_the_stream():
    v = lm.Vocabulary([b"a", b"b", b"c"], np.array([5, 4, 3]), [b"a", b"b", b"c"], np.array([5, 4, 3]), np.full(lm.TAIL, 2), np.full(lm.TAIL, 1), 20, 10, 4)
    w = lm.first_weights(v, hidden=4)
    after = lm.train(w, [np.array([0, 1] * 600 + [2], np.int32)], v)
    assert after["bo"][2] != pytest.approx(lm.train(w, [np.array([0, 1] * 600 + [1], np.int32)], v)["bo"][2])


# pipeline -----------------------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path, rows):
    rng = random.Random(20)
    docs = [(i, prose(rng, 60), "x", "s", 1) for i in range(80)]
    item = prose(rng, 30)
    docs += [(200, docs[3][1], "x", "s", 1), (201, None, "x", "s", 1), (202, "12 34", None, "s", 1), (203, prose(rng, 20) + " " + item + " " + prose(rng, 20), "x", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, str(tmp_path))
        assert out.columns == read.columns
        read = out.sparkSession.createDataFrame(out.collect(), out.schema)
    assert sorted(r["doc_id"] for r in read.collect()) == list(range(80))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in whole.select("doc_id").where(F.col("start") == 0).collect()}) == list(range(80))
