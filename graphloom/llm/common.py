"""What the operators share: tables, the shared work folder, folds and text helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Entries that a worker's word cache may hold before it is emptied.
CACHE_ENTRIES = 150_000
#: The same where tokens are made, which costs more than looking them up by far.
CHUNK_ENTRIES = 400_000


_tool: list = []


def worker_tool(key, make):
    """An operator's lookup tables and caches, kept in a Python worker between tasks.

    Workers serve all stages of an application, so only one operator's are held at a time.
    """
    if not _tool or _tool[0] != key:
        _tool.clear()
        release()
        _tool[:] = [key, make()]
    return _tool[1]


def release() -> None:
    """Give memory that a fit on the driver has used back to the system, where the C library can."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back(spark: SparkSession) -> None:
    """Have the executors' JVMs collect and give heap that a finished stage has left unused back to the system.

    A heap grows to its limit and stays there, beside which the next stage's Python workers have to find room. One short task
    for each core, so that every executor gets some; one that gets none keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


@lru_cache(1)
def one_thread() -> None:
    """Keep matrix products of this process on one thread: executors run a task on every core, and products here are small."""
    import numpy  # noqa: F401  (loads the library)

    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:
        return
    for path in paths:
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            f = getattr(ctypes.CDLL(path), name, None)
            if f:
                f(1)
                break


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    for tables in _scratch:
        tables.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch(keep: list[DataFrame]):
    """Deletes the tables settled inside, but for those put into ``keep``, when the block is left."""
    tables: list[DataFrame] = []
    _scratch.append(tables)
    try:
        yield
    finally:
        _scratch.pop()
        paths = {getattr(k, "_settled_path", None) for k in keep}
        for t in tables:
            if t._settled_path not in paths:
                discard(t)


def discard(df: DataFrame) -> None:
    """Delete a settled table once nothing reads it any more."""
    path, spark = getattr(df, "_settled_path", None), df.sparkSession
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BitFilter:
    """Tells, without a shuffle, which rows may hold one of the given keys: a bit array in a broadcast row.

    It takes ``per_key`` bits a key, 32 MB at most however many keys there are; a fuller one lets more
    rows through, which an exact join afterwards sorts out. Nulls are no keys.
    """

    MOST = 28

    def __init__(self, keys: DataFrame, *columns: str, per_key: int = 16):
        self.columns = columns
        keys = keys.select(*columns).dropna()
        self.bits = 1 << min(self.MOST, max(12, (per_key * keys.count()).bit_length()))
        place = self._place()
        words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
        every = keys.sparkSession.range(self.bits >> 6, numPartitions=1).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))
        self.row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("__bits"))

    def _place(self) -> Column:
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.bits))

    def _join(self, rows: DataFrame, how: str) -> DataFrame:
        place = self._place()
        held = F.getbit(F.col("__bits")[F.shiftright(place, 6).cast("int")], place.bitwiseAND(F.lit(63)).cast("int")) == 1
        for c in self.columns:
            held = F.col(c).isNotNull() & held
        return rows.join(F.broadcast(self.row), held, how)

    def among(self, rows: DataFrame) -> DataFrame:
        """The rows that may hold a key, and some that do not."""
        return self._join(rows, "left_semi")

    def clear(self, rows: DataFrame) -> DataFrame:
        """The rows that hold none for certain, those with nulls among them."""
        return self._join(rows, "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among the ids (one column ``key``); only rows that the bit filter doubts are shuffled."""
    known = BitFilter(ids, key)
    left = known.among(docs).join(ids.select(key), key, "left_anti").select(*docs.columns)
    return known.clear(docs).select(*docs.columns).union(left)


def literal_rows(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A few rows as a table without Python workers."""
    lit = lambda v, f: F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(f.dataType).alias(f.name)
    if not rows:
        return spark.range(0).select(*(lit(None, f) for f in schema))
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(lit(v, f) for v, f in zip(r, schema))) for r in rows))))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", least: int = 1024, hint: str | None = None) -> DataFrame:
    """An equi-join whose left side may hold a key any number of times (right: few times a key).

    Keys with more than 1 / 512 of the left rows (so fewer than 512 keys, which the driver sees) are
    dealt over as many shares, and their right rows are repeated for each share. ``hint`` fixes the kind of join, where
    a right side looks smaller to the planner than it is.
    """
    share = max(least, left.count() // 512)
    counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > share)
    hot = counted.select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__shares"))
    rows = hot.collect()
    if not rows:
        return left.join(right.hint(hint) if hint else right, keys, how)
    hot = literal_rows(left.sparkSession, rows, hot.schema)
    shares = F.coalesce("__shares", F.lit(1))
    rest = [c for c in left.columns if c not in keys]
    own = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*rest) if rest else F.monotonically_increasing_id(), shares).cast("int")).drop("__shares")
    other = right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return own.join(other.hint(hint) if hint else other, [*keys, "__salt"], how).drop("__salt")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have the session send Python workers at most so many rows at a time, unless it asks for fewer: texts are long, and both sides hold a batch.

    For operators whose result is computed after they return.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Jobs run inside send Python workers so many rows at a time: whole texts and sets are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def held_out(doc_id: str, n: int, remainder: int) -> Column:
    """Whether the id falls into the held-out fold; a null id does not (it is not learned from either)."""
    return F.coalesce(crc_mod(doc_id, n) == remainder, F.lit(False))


def text_batches(batch, size: int = 256):
    """(offset, list of str) slices of an Arrow batch's ``text`` column; null is the empty text."""
    column = batch.column(batch.schema.get_field_index("text"))
    for at in range(0, len(column), size):
        yield at, [t or "" for t in column.slice(at, size).to_pylist()]


@lru_cache(1)
def byte_table() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, back to bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def stand_ins() -> dict[int, str]:
    """For ``str.translate``: each character up to U+00FF to the stand-ins of its UTF-8 bytes."""
    of = {b: c for c, b in byte_table().items()}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(256)}


#: Printable ASCII and the letters of Latin-1: normal forms leave them alone and their classes are plain.
PLAIN = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
LETTER = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
