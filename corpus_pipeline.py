"""The corpus pipeline: quality, near copies, repeated strings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``docs`` is what the stage
before it kept. All stages but the last return the columns of ``documents``.

Null texts and ids, empty and very long texts, ties and repeated rows are handled by each
stage as its operator's docstring says: quality, repeats and personal_data treat each row
by itself (a null text is scored as an empty one and stays null), near_dedup keeps one row
of a doc_id and one of exact copies without an id, packing gives a document without text
its end mark only. An empty table gives no row at any stage; further columns, whatever
their names, pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import near_dedup, packing, pii, quality, shared, suffix_dedup
from tidegrid.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, resemblance of 0.8 or more."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes in 100-byte strings that occur earlier."""
    return suffix_dedup.without_repeats(docs, length=100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked by its kind."""
    return pii.masked(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows that hold the sources' proportions."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, window=4096, kept_words=100_000)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]

#: SQL can't train the models or run the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
