"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from adloom.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, COLUMNS).where("score < 0.7").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the one with the least doc_id, rows without an id last.

    Rows are judged, not ids, so rows of one id with unlike texts are kept or dropped
    each for itself.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def remove_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what is covered by repeated 200-byte strings."""
    out = suffix_dedup.keep_text(docs, ["doc_id", "lang", "source"])
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_leaked_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_leaky(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_text),
    ("benchmark_decontamination", drop_leaked_benchmarks),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages; tests compare the rows of each with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
