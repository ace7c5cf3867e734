"""The corpus pipeline: stages over `documents`, each of which calls one operator.

Every stage takes what the stage before it kept, as a table, and all but the last give
back the columns of documents, whatever else these are called.

Defined results, in every stage: an empty table gives an empty one. Texts are used
whole, however long. Rows with a null doc_id or a null or empty text are kept by all
stages (the last counts no tokens for such a text), unless the quality classifier
rejects their site. Repeated rows are judged alike; near-dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, neardup, quality, repeats
from tessera.llm.shared import drop, read, scratch, stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects: documents of low quality and toxic ones.

    A null or empty text is judged by its site; without labels nothing is dropped. A
    posterior at the threshold rejects.
    """
    return quality.good(docs, read(spark, sf_dir, "labels"))


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, at a similarity of 0.8, the document of the smallest id stays, once.

    Null and empty texts are linked with nothing; of equal rows one stays. Pairs at exactly
    0.8 are linked.
    """
    return neardup.distinct_documents(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of smaller id has too out of the texts; documents stay, with n_chars of the new text.

    A text that loses nothing stays as it is, null or empty too; of rows with equal ids
    none is before the other.
    """
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts hold none; equal rows go or stay together."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids and digests of ids and decoded text, a row for each row; a null or empty text has no ids."""
    return bpe.encoded(docs, bpe.default_path(), extra=("ids",))


STAGES = [
    ("quality", keep_good),
    ("near-dedup", keep_first_of_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The stages have no counterpart in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs, at = stash(stage(spark, docs, sf_dir))
            kept.append(at)
        drop(spark, *before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
