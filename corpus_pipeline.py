"""From documents to packed training sequences: quality, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. ``run`` writes each stage's result as Parquet to the shared checkpoint folder and reads it
again for the next one, so a lost executor costs one stage's tasks at most; what earlier stages wrote is deleted at the end.

Defined results of all stages: a null text is the empty text, which the quality stage judges like any other, of which the
second stage keeps one, and which packs to its closing id; a null or repeated id names a row like any other, and rows are
told apart by their texts; a text of any length is read whole; an empty table gives no rows; further columns stay as they
are up to the last stage, whatever their names, which returns pieces alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sealmark.llm import near_dup, packing, quality, secrets
from sealmark.llm._common import prepare, saved, scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; equal rows are kept or go alike, and a language without trusted documents is kept."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates; of rows that are equal one stays, any id goes before null."""
    return near_dup.deduplicate(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark; a null text stays null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens, with their ids; repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("secrets", no_secrets),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(prepare(spark)) as keep:
        for n, (_, stage) in enumerate(STAGES[:-1], 1):
            docs = (keep if n == len(STAGES) - 1 else saved)(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
