"""From raw documents to packed training sequences, a stage at a time.

Every stage but the last takes and returns the columns of documents; others that its input has are dropped,
whatever their names. A null text has no letter and goes in the first stage; the later stages keep one, were
it to reach them. A null doc_id is kept as such and told apart by its text, rows that repeat are judged
alike, and of copies the one with the least doc_id stays (null last, then the least text hash). An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, langid, lines, neardup, packing
from tideline.llm.common import table
from tideline.plans.shared import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: without a letter, or with a narrow margin between two
    languages. Without any labelled text nothing can be told, so every document is rejected."""
    model = langid.train(docs.where(~langid.is_held_out(F.col("doc_id"))))
    return langid.identify(docs, model).where("NOT rejected").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, and the documents of which nothing is left."""
    out = lines.dedup_lines(docs).where("n_deleted = 0 OR trim(replace(text, '\n', ' ')) <> ''")
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates; rows with the same doc_id and text stay together."""
    return neardup.drop_near_duplicates(docs).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL can express neither compression, weighted sampling nor packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
