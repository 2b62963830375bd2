"""Token counts by a whole-token shortcut.

Offline it is proved, by encoding every vocabulary string alone, which strings are one token.
A text is cut at white space into chunks that the tokenizer's own pre-tokenizer never joins;
chunks and pre-tokens found in the proved set count as one, only the rest is merged by the library.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from graphloom.llm.common import CHUNK_ENTRIES, LETTER, PLAIN, byte_table, stand_ins, text_batches, worker_tool

#: Cuts where byte-level pre-tokenization cuts at white space; the pieces are independent of each other.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these four as white space, Unicode's White_Space property does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


#: The pre-tokenizer's pattern, for chunks of plain characters.
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\\s0-9{LETTER}]+")


def prove_whole_tokens(tokenizer) -> frozenset[str]:
    """Vocabulary strings (as plain text) that the tokenizer encodes, alone, as exactly one token."""
    back, plain = byte_table(), []
    for piece in tokenizer.get_vocab(with_added_tokens=False):
        try:
            plain.append(bytes(back[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    encoded = tokenizer.encode_batch(plain, add_special_tokens=False)
    return frozenset(s for s, e in zip(plain, encoded) if len(e.ids) == 1)


class TokenCounter:
    """Counts a text's tokens exactly as ``tokenizer.encode`` would.

    ``spaced_bpe`` tokenizers only: byte-level BPE without normalizer whose pre-tokenizer is the
    usual word pattern. Any other file, and any text with a special string or an odd separator,
    goes through the library as a whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.shortcut = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("truncation") and not spec.get("padding") and spec.get("post_processor") is None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.whole = prove_whole_tokens(self.tokenizer) if self.shortcut else frozenset()
        self.cache: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _learn(self, chunks: set[str]) -> None:
        """Count chunks not met before: whole tokens as one, merging only the other parts."""
        known, merge, plain = self.cache, self.tokenizer.model.tokenize, stand_ins()
        if len(known) + len(chunks) > CHUNK_ENTRIES:
            known = self.cache = dict.fromkeys(self.whole, 1)
        odd = []
        for c in chunks:
            if c.isspace() or not PLAIN(c):
                odd.append(c)
                continue
            n = 0
            for part in _PART.findall(c):
                k = known.get(part)
                if k is None:
                    k = known[part] = len(merge(part.translate(plain)))
                n += k
            known[c] = n
        for c, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
            known[c] = len(e.ids)

    def count(self, texts: list[str]) -> list[int]:
        whole = [not self.shortcut or any(s in t for s in self.special) or bool(_ODD_SPACE.search(t)) for t in texts]
        chunked = [() if w else _CHUNK.findall(t) for t, w in zip(texts, whole)]
        unknown: set[str] = set()
        for chunks in chunked:
            unknown.update(chunks)
        known = self.cache.keys()
        missing = {c for c in unknown if c not in known}
        if missing:
            if len(self.cache) + len(missing) > CHUNK_ENTRIES:
                missing = unknown - self.whole
            self._learn(missing)
        get = self.cache.__getitem__
        return [len(self.tokenizer.encode(t, add_special_tokens=False).ids) if w else sum(map(get, chunks)) for t, w, chunks in zip(texts, whole, chunked)]


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, UTF-8 bytes, tokens, whether tokens exceed ``limit``.

    Null text counts as empty (0 bytes, 0 tokens); a null id is kept; repeated rows each give a row;
    columns other than the two are ignored; an empty table gives no rows. One pass, no shuffle.
    """
    path = tokenizer_path or default_vocabulary()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        counter = worker_tool(("tokens", path), lambda: TokenCounter(path))
        for batch in batches:
            sizes, counts = [], []
            for _, texts in text_batches(batch):
                sizes += [len(t.encode()) for t in texts]
                counts += counter.count(texts)
            counts = pa.array(counts, pa.int64())
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), counts, pa.compute.greater(counts, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])


    return rows.mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
