"""Rows that no operator may trip over, and the models behind op2, op5 and op8 recomputed plainly."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import decontaminate, langid, licenses, lm, minhash, packing, quality, tokens, toxicity, vectors
from graphloom.llm.common import BitFilter, salted_join, without_ids

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(1, 9))) for _ in range(200)]
CLASHING = ("kept", "component_id", "n_shingles", "n_tokens", "held_out", "labels", "sequence_id", "selected", "score", "similarity", "rid", "id", "rep", "n", "key", "a", "b", "h", "w")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, 40), "xy"[i % 2]) for i in range(12)]
    docs += [(20, None, "x"), (21, "", "y"), (22, " \n\t", None), (None, prose(rng, 30), "x"), (None, None, None), (23, docs[0][1], "x"), (23, docs[0][1], "x"), (24, prose(rng, 60_000), "y"), (25, "q" * 150_000, "x"), (26, "12 %%", None)]
    extra = ", ".join(f"{c} int" for c in CLASHING)
    docs = spark.createDataFrame([(*d, "s", 1, *range(len(CLASHING))) for d in docs], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0), 1) for i in range(12)] + [(None, 1, 1, 1), (3, None, None, 1)], "doc_id bigint, quality int, toxic int, score int")
    items = spark.createDataFrame([(0, docs.first()["text"], 1), (1, None, 1), (None, "a b c", 1), (2, "", 1)], "item_id bigint, text string, n int")
    vecs = spark.createDataFrame([(i, [float(i % 3), 1.0], 1) for i in range(9)] + [(None, [1.0, 1.0], 1), (9, None, 1), (10, [], 1)], "vec_id bigint, embedding array<float>, links int")
    return docs, labels, items, vecs


OPERATORS = {
    "op1": lambda d, l, i, v: minhash.near_duplicates(d),
    "op2": lambda d, l, i, v: toxicity.classify(d, l),
    "op4": lambda d, l, i, v: licenses.scan(d),
    "op5": lambda d, l, i, v: langid.identify(d),
    "op6": lambda d, l, i, v: vectors.near_vectors(v),
    "op8": lambda d, l, i, v: quality.resample(d, l),
    "op9": lambda d, l, i, v: tokens.count_tokens(d),
    "op10": lambda d, l, i, v: lm.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(tables, name):
    source = tables[3] if name == "op6" else tables[0]
    id_name = source.columns[0]
    out = OPERATORS[name](*tables)
    assert len(set(out.columns)) == len(out.columns)
    assert Counter(r[0] for r in out.select(id_name).collect()) == Counter(r[0] for r in source.select(id_name).collect())
    none = OPERATORS[name](*(t.limit(0) for t in tables))
    assert none.columns == out.columns and none.count() == 0


def test_leaks_and_pieces(tables):
    docs, _, items, _ = tables
    assert sorted(map(tuple, decontaminate.find_leaks(docs, items).select("doc_id", "item_id").collect())) == [(0, 0), (23, 0)]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    found = packing.pack(docs)
    assert {r["doc_id"] for r in found.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packing.pack(docs.limit(0)).count() == 0


def test_stages_keep_columns_and_null_ids(spark, tables, tmp_path):
    docs, labels, items, _ = tables
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept[name] = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert not {20, 21, 22, 26} & set(kept["language_id"]) and kept["toxicity"][None] == 2
    assert kept["near_dedup"][None] == 2 and kept["near_dedup"][23] == 0 and kept["near_dedup"][0] == kept["near_dedup"][20] == 1
    assert kept["decontamination"][None] == 2 and not {0, 23} & set(kept["decontamination"]) and kept["decontamination"][1] == 1
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# what the joins share ---------------------------------------------------------------------------
def test_bit_filter_and_removal(spark):
    rows = spark.createDataFrame([(i, "t") for i in range(500)] + [(None, "t")], "doc_id bigint, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,), (9999,)], "doc_id bigint")
    known = BitFilter(ids, "doc_id")
    assert {r["doc_id"] for r in known.among(rows).collect()} >= set(range(0, 500, 7))
    assert known.among(rows).count() + known.clear(rows).count() == 501
    assert Counter(r["doc_id"] for r in without_ids(rows, ids).collect()) == Counter([i for i in range(500) if i % 7] + [None])
    assert without_ids(rows, ids.limit(0)).count() == 501


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(900)] + [(i, i) for i in range(2, 60)], "k int, x int")
    right = spark.createDataFrame([(i, -i) for i in range(0, 40)] + [(1, -100)], "k int, y int")
    got = Counter(map(tuple, salted_join(left, right, ["k"], least=50).select("k", "x", "y").collect()))
    assert got == Counter(map(tuple, left.join(right, "k").select("k", "x", "y").collect())) and sum(got.values()) == 1838


# op2 ----------------------------------------------------------------------------------------------
def test_windows_hold_the_whole_text():
    rng = random.Random(8)
    for _ in range(200):
        words = [rng.choice(WORDS + ["a", "it", "the", "x" * 90]) for _ in range(rng.randrange(0, 30))]
        found = toxicity.windows(" ".join(words))
        assert all(0 < len(w) <= toxicity.WINDOW for w in found)
        held = Counter(w for f in found for w in f.decode().split())
        assert all(held[w] for w in words if len(w) <= 8)
    assert toxicity.windows("You, idiot; it is.") == [b"idiot", b"you idiot", b"it is"]
    assert toxicity.windows("ass") == [b"ass"]


def test_saved_bytes_are_compressed_lengths():
    import zstandard as z

    side = toxicity._Side(b" idiotic clowns are pathetic ")
    how = z.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=4, target_length=32, strategy=z.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0)
    raw = z.ZstdCompressionDict(b" idiotic clowns are pathetic  " + toxicity._HEAD, dict_type=z.DICT_TYPE_RAWCONTENT)
    length = lambda w: len(z.ZstdCompressor(compression_params=how, dict_data=raw).compress(toxicity._HEAD + w + toxicity._TAIL))
    for w in (b"idiotic", b"clowns", b"zqwvxk", b"a", b"the pathetic"):
        assert side(w) == length(b"") + len(w) - length(w)
    assert side(b"idiotic") > 3 > side(b"zqwvxk")


def test_toxicity_in_short_words(spark):
    rng = random.Random(3)
    plain = [w for w in WORDS if len(w) > 3]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        for _ in range(4 * (i % 4 == 0)):
            at = rng.randrange(len(words))
            words[at : at + 1] = ["zu", "wix", "ko"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    out = toxicity.classify(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("held_out").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out) / len(out) > 0.95


# op5 ----------------------------------------------------------------------------------------------
def _plain_expected(word, at, prob):
    """Piece counts of one word by exact forward and backward sums over fractions of logarithms."""
    s = "▁" + word
    edges = [[] for _ in range(len(s) + 1)]
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 40) + 1):
            if s[i:j] in at:
                edges[i].append((j, at[s[i:j]], math.log(prob[at[s[i:j]]])))
        if s[i] not in at:
            edges[i].append((i + 1, -1, sum(math.log(prob[at[f"<0x{b:02X}>"]]) for b in s[i].encode())))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    f, b = [-math.inf] * (len(s) + 1), [-math.inf] * (len(s) + 1)
    f[0] = b[len(s)] = 0.0
    for i in range(len(s)):
        for j, _, p in edges[i]:
            f[j] = add(f[j], f[i] + p)
    for i in range(len(s) - 1, -1, -1):
        for j, _, p in edges[i]:
            b[i] = add(b[i], p + b[j])
    out = Counter()
    for i in range(len(s)):
        for j, k, p in edges[i]:
            if k >= 0:
                out[k] += math.exp(f[i] + p + b[j] - f[len(s)])
    return f[len(s)], out


def test_words_of_any_length_are_learned_from():
    path = langid.default_vocabulary()
    pieces = langid.vocabulary(path)
    at, rng = {p: k for k, p in enumerate(pieces)}, random.Random(7)
    prob = langid.fit_words({"a": Counter(["hello", "world", "abcab"] * 3)}, path).table[:, 0]
    words = ["hello", "".join(rng.choice("abcdeh") for _ in range(41)), "".join(rng.choice("0123456789abcdef") for _ in range(400)), "日本🙂語" * 60, "aé🙂" * 3]
    finder = langid.pieces_of(path)
    for w in words:
        log_p, want = _plain_expected(w, at, prob)
        assert langid.word_log_probs(prob[:, None], finder, [w])[0, 0] == pytest.approx(log_p, rel=1e-9)
        got = langid._expected(Counter({w: 3}), prob, finder)
        assert got.sum() == pytest.approx(3 * sum(want.values()), rel=1e-6)
        for k, x in want.items():
            assert got[k] == pytest.approx(3 * x, rel=1e-6, abs=1e-9)


def test_predictions_against_plain_sums(spark):
    path = langid.default_vocabulary()
    at = {p: k for k, p in enumerate(langid.vocabulary(path))}
    docs = [(i, t, k) for i, (t, k) in enumerate([("hello world", "en"), ("bonjour le monde", "fr"), ("hello there", "en"), ("le monde", "fr"), ("hallo welt", "de"), ("die welt", "de")] * 4)]
    docs += [(100, "Hello monde", None), (101, "x", None), (102, "welt" * 200, None)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = langid.fit(rows)
    for r in langid.identify(rows, model=model).collect():
        text = docs[[d[0] for d in docs].index(r["doc_id"])][1]
        total = [sum(_plain_expected(w, at, model.table[:, k])[0] for w in text.lower().split()) for k in range(len(model.languages))]
        best = max(range(len(total)), key=lambda k: total[k])
        assert r["lang_pred"] == model.languages[best]
        assert r["score"] == pytest.approx(1 / sum(math.exp(max(-700, x - total[best])) for x in total), rel=1e-6)


def test_equal_languages_tie_by_name(spark):
    rows = spark.createDataFrame([(i, "kolo mira", "yx"[i % 2]) for i in range(40)], "doc_id bigint, text string, lang string")
    same = langid.LanguageModel(("x", "y"), np.repeat(langid.fit(rows).table[:, :1], 2, axis=1), langid.default_vocabulary())
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(rows, model=same).collect()} == {("x", 0.5)}


# op8 ----------------------------------------------------------------------------------------------
def _buckets(text):
    h = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    pairs = [(((x * 0x9E3779B97F4A7C15 + y) & 0xFFFFFFFFFFFFFFFF) >> 40) % quality.BUCKETS for x, y in zip(h, h[1:])]
    return [x % quality.BUCKETS for x in h] + pairs


def test_importance_weights_against_brute_force(spark):
    rng = random.Random(14)
    docs = [(i, prose(rng, rng.randrange(1, 60)) + (" ### ZZZ" * 9 if i % 5 == 0 else "")) for i in range(200)] + [(300, None), (301, ""), (302, "Donaudampfschifffahrtsgesellschaft" + "x"), (303, "Donaudampfschifffahrtsgesellschaft" + "y")]
    good = [i for i in range(200) if i % 5]
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(200)], "doc_id bigint, quality int")
    out = quality.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), labels, fraction=0.6).collect()
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in docs:
        for b in _buckets(t):
            raw[b] += 1
            target[b] += i in good and zlib.crc32(str(i).encode()) % 3 != 1
    p = (target + 10_000 * raw / raw.sum() + 1e-3) / (target.sum() + 10_000 + 1e-3 * quality.BUCKETS)
    q = (raw + 1e-3) / (raw.sum() + 1e-3 * quality.BUCKETS)
    text = dict(docs)
    for r in out:
        found = _buckets(text[r["doc_id"]])
        assert r["n_grams"] == len(found)
        assert r["log_weight"] == pytest.approx(sum(math.log(p[b] / q[b]) for b in found), abs=1e-6)
    by = {r["doc_id"]: r for r in out}
    assert by[302]["key"] != by[303]["key"] and _buckets(text[302]) != _buckets(text[303])
    k = math.ceil(0.6 * len(docs))
    assert {r["doc_id"] for r in out if r["selected"]} == {r["doc_id"] for r in sorted(out, key=lambda r: -r["key"])[:k]}
    noise = np.array([r["key"] - r["log_weight"] for r in out])
    assert abs(noise.mean() - 0.5772) < 0.35 and 0.8 < noise.std() < 1.8  # Gumbel noise at temperature 1


def test_pipeline_stages_start_with_the_memory_of_others_given_back(spark, tmp_path):
    def whole_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(beans.get(k).getCollectionCount() for k in range(beans.size()) if "Old" in beans.get(k).getName() or "MarkSweep" in beans.get(k).getName())

    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id bigint, text string")
    before = whole_collections()
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert whole_collections() > before
