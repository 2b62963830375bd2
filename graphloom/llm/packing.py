"""Packing documents into fixed-length training sequences with bounded space.

Each partition keeps at most ``open_windows`` open windows. A document (what is left of it after
whole windows) goes to the window it fits best; when it fits none and all windows are in use, the
fullest is topped up with the document's head and emitted. What remains open at a partition's end
is lined up over all partitions and cut at multiples of the length; the last, partial stretch is
cut into powers of two. No sequence needs padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import CHUNK_ENTRIES, LETTER, PLAIN, bounded_batches, settle, stand_ins, text_batches, worker_tool

#: The pre-tokenizer's pattern, for lower-cased chunks of plain characters.
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\\s0-9{LETTER}]+")
_ODD = re.compile("[\x1c-\x1f]|<\\|")
PIECE = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class WordIds:
    """Token ids of a text as little-endian 32-bit bytes, put together from cached white-space chunks.

    The vocabulary's pre-tokenizer drops white space, so chunks between it never share a token.
    Texts that may hold special strings or odd separators go through the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.parts = Tokenizer.from_file(path), {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.chunked = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s" not in str(first.get("pattern")).replace("[^\\\\s", "")

    def _learn(self, chunks: list[str]) -> None:
        known, parts, merge, plain, odd = self.cache, self.parts, self.tokenizer.model.tokenize, stand_ins(), []
        if len(parts) > CHUNK_ENTRIES:
            parts.clear()
        for c in chunks:
            if not PLAIN(c):
                odd.append(c)
                continue
            found = []
            for part in _PART.findall(c.lower()):
                ids = parts.get(part)
                if ids is None:
                    ids = parts[part] = array("I", [t.id for t in merge(part.translate(plain))]).tobytes()
                found.append(ids)
            known[c] = b"".join(found)
        for c, e in zip(odd, self.tokenizer.encode_batch(odd, add_special_tokens=False)):
            known[c] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [not self.chunked or bool(_ODD.search(t)) for t in texts]
        split = [() if w else t.split() for t, w in zip(texts, whole)]
        seen: set[str] = set().union(*split)
        missing = [c for c in seen if c not in self.cache]
        if len(self.cache) + len(missing) > CHUNK_ENTRIES:
            self.cache, missing = {}, list(seen)
        if missing:
            self._learn(missing)
        get = self.cache.__getitem__
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w else b"".join(map(get, s)) for t, w, s in zip(texts, whole, split)]


class Packer:
    """Bounded-space online best fit. ``out`` gets rows (window, full, id, start, length, crc, total, offset, ids)."""

    def __init__(self, size: int, open_windows: int):
        self.size, self.most, self.next = size, open_windows, 0
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.held: dict[int, list] = {}
        self.out: list[tuple] = []

    def _put(self, window: int, free: int, doc, start: int, ids: bytes, total: int) -> None:
        self.held[window].append((window, True, doc, start, len(ids) // 4, zlib.crc32(ids), total, self.size - free, ids))
        free -= len(ids) // 4
        if free:
            insort(self.free, (free, window))
        else:
            self.out += [(*row[:-1], None) for row in self.held.pop(window)]

    def _new(self) -> int:
        self.next += 1
        self.held[self.next - 1] = []
        return self.next - 1

    def add(self, doc, ids: bytes) -> None:
        total, start, size = len(ids) // 4, 0, self.size
        while total - start >= size:
            self._put(self._new(), size, doc, start, ids[4 * start : 4 * (start + size)], total)
            start += size
        while start < total:
            left = total - start
            at = bisect_left(self.free, (left, -1))
            if at < len(self.free):
                free, window = self.free.pop(at)
            elif len(self.free) < self.most:
                free, window = size, self._new()
            else:
                free, window = self.free.pop(0)
            take = min(free, left)
            self._put(window, free, doc, start, ids[4 * start : 4 * (start + take)], total)
            start += take

    def rest(self) -> list[tuple]:
        """The open windows' rows, not full; offset is the place in this partition's line of leftovers."""
        rows, at = [], 0
        for window in sorted(self.held):
            for row in self.held[window]:
                rows.append((window, False, *row[2:7], at, row[8]))
                at += row[4]
        return rows


def _cuts(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences of the last partial stretch of ``total`` tokens: powers of two, largest first."""
    at, left, cuts = total - total % size, total % size, []
    while left:
        n = 1 << (left.bit_length() - 1)
        cuts.append((at, n))
        at, left = at + n, left - n
    return cuts


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = 4096, end_id: int = 2, open_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the end token alone; null ids and repeated rows are packed like others;
    texts longer than a sequence are cut; an empty table gives no rows. Tokens are made once; what
    the partitions leave open (a bounded number of windows each) is the only part written with ids.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    path = tokenizer_path
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    kinds = [pa.int64(), pa.bool_(), None, *[pa.int64()] * 5, pa.binary()]
    names = ["window", "final", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "ids"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, packer, part, id_arrow = worker_tool(("packing", path), lambda: WordIds(path)), Packer(size, open_windows), TaskContext.get().partitionId(), pa.int64()

        def batch_of(found):
            cols = list(zip(*found)) if found else [[]] * len(names)
            return pa.record_batch([pa.array([part] * len(found), pa.int64()), *(pa.array(c, id_arrow if k is None else k) for c, k in zip(cols, kinds))], ["part", *names])

        for batch in batches:
            id_arrow = batch.column(0).type
            for at, texts in text_batches(batch):
                for doc, ids in zip(batch.column(0).slice(at, len(texts)).to_pylist(), words.ids(texts)):
                    packer.add(doc, ids + end)
                if len(packer.out) >= 4096:
                    yield batch_of(packer.out)
                    packer.out = []
        if packer.out or packer.held:
            yield batch_of(packer.out + packer.rest())

    pieces = settle(rows.mapInArrow(run, f"part bigint, window bigint, final boolean, doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, offset bigint, ids binary"), "packing")
    done = pieces.where("final").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.expr("shiftleft(part, 32) + window").alias("sequence_id"), "offset")
    # One number per partition comes to the driver: where its leftovers stand in the line of all.
    sums = pieces.where("not final").groupBy("part").agg(F.sum("length").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        base[r["part"]] = total
        total += r["n"]
    tail = _cuts(total, size)
    line, first_tail = -(1 << 62), total - total % size

    def merge(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                at, done, ids = base[r["part"]] + r["offset"], 0, r["ids"]
                while done < r["length"]:
                    here = at + done
                    if here < first_tail:
                        begin, n = here - here % size, size
                    else:
                        begin, n = next(c for c in reversed(tail) if c[0] <= here)
                    take = min(r["length"] - done, begin + n - here)
                    part = ids[4 * done : 4 * (done + take)]
                    found.append((r["doc_id"], r["start"] + done, take, zlib.crc32(part), r["doc_tokens"], line + begin, here - begin))
                    done += take
            if found:
                cols = list(zip(*found))
                yield pa.record_batch([pa.array(cols[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", *names[3:7], "sequence_id", "offset"])

    schema = f"{PIECE.format(id=id_type)}, sequence_id bigint, offset bigint"
    merged = pieces.where("not final").select("part", "doc_id", "start", "length", "doc_tokens", "offset", "ids").mapInArrow(merge, schema)
    return done.unionByName(merged).withColumnRenamed("doc_id", id_col)
