"""The training-data pipeline: five operators of ``rollcall.llm`` one after another.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet in the shared folder and
read again as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontaminate, jaccard, mixing, packing, toxicity
from rollcall.llm.rows import table
from rollcall.session import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language.

    Null and empty texts are scored like texts without words; a null or rare language has the
    common threshold; rows that repeat are judged alike; without labels of both classes, or without
    documents, nothing is rejected; further columns are kept.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Null and empty texts are near copies of nothing and stay, as do rows without doc_id; rows that repeat
    under a kept id all stay; versions of one id belong together; further columns are kept.
    """
    return jaccard.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; each row is judged by its own text, so rows that repeat or share
    an id are judged one by one; items without words match nothing; further columns are kept.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own, after all others; documents without words (null, empty) are in no mix; of rows
    equal in id, text and source one is repeated for all of them; the row at a source's cut is shortened; further
    columns are kept.
    """
    return mixing.mixed_documents(docs)


def pack_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed id rows.

    A null or empty text gives the end id alone; rows that repeat are each packed; a null doc_id is kept as null; no
    documents give no rows; further columns are ignored.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_rows),
]

# A trained net and hash-dealt packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
