"""A corpus pipeline of five stages over ``documents``; each stage's result is written and read again.

Language identification and toxicity drop what they reject, near-duplicates keep one document of each
group, decontamination drops documents that hold a benchmark item, packing makes sequences of the rest.
Each stage but the first has the executors give back the memory of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, toxicity
from graphloom.llm.common import BitFilter, discard, give_back, scratch, settle, table, without_ids
from graphloom.llm.decontaminate import find_leaks
from graphloom.llm.minhash import near_duplicates
from graphloom.llm.packing import pack

#: A document whose best language has less than this posterior is rejected, as is one without a letter.
LANGUAGE_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, in their columns; the model is fitted on the labelled rows of the input itself.

    Null and empty texts and texts without a letter go. Rows with null ids and repeated rows are judged like others; a null
    ``lang`` is not learned from. An empty table, or one without any label, gives no rows.
    """
    model = langid.fit(docs)
    found = langid.predictor(docs, model, docs["text"])
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LANGUAGE_SCORE))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, in their columns.

    Null and empty texts are not toxic. Rows with null ids and repeated rows are judged like others. Without labels of both
    classes nothing goes; an empty table gives no rows.
    """
    give_back(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer_column(docs, model, docs["text"])["predicted"] == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group at similarity 0.8 over five words, in the columns of the input.

    Rows with null ids, and null, empty and wordless texts, are in no group and stay. Of several rows of one id
    one stands. An empty table gives no rows.
    """
    give_back(spark)
    found = settle(near_duplicates(docs, width=5, percent=80), "near")
    left = without_ids(docs, found.where("not kept").select("doc_id").distinct())
    repeated = settle(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = BitFilter(repeated, "doc_id").among(left).join(repeated, "doc_id", "left_semi").select(docs.columns)
    return without_ids(left, repeated).unionByName(once.dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, in their columns.

    Null ids cannot be reported and stay, as do null and empty texts; all rows of a reported id go. An empty table, or one
    of items, takes nothing away.
    """
    give_back(spark)
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without_ids(docs, leaks)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``pack`` returns them: one at least for each row, null texts as empty ones."""
    give_back(spark)
    return pack(docs)


STAGES = [
    ("language_id", keep_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Compression lengths and summed segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. Empty tables give no rows; what a stage wrote on its way is deleted once its result is written."""
    docs, keep = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(keep):
            new = settle(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(new)
        discard(docs)
        docs = new
    return docs
