"""The corpus pipeline: documents through five operators, each stage a table of its own.

A stage's result is written before the next stage begins, which therefore first deletes the
tables that the stage before has needed.

Defined results, of all stages: a null text counts as empty where it is measured and stays null where it is kept; the
first stage rejects it, as it rejects texts of under 20 words, and the others take it as their operators say; repeated
rows are one record in the second stage and rows of their own in the others; an empty table gives an empty
table; all columns of docs are carried by the first four stages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from genospark.llm import jaccard_join, mixing, quality, sp_tokens, substring_dedup
from genospark.plans.tables import collected, removed, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: This thread's latest stage, by its place, and the tables that its result reads.
_left: ContextVar[tuple[int, list[str]]] = ContextVar("left")


def stage(place: int) -> Callable[[Stage], Stage]:
    def ranked(f: Stage) -> Stage:
        @wraps(f)
        def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before, tables = _left.get((-1, []))
            if before == place - 1:  # else the result of the stage called last may still be read
                removed(spark, tables)
            with collected() as made:
                out = f(spark, docs, sf_dir)
            _left.set((place, made))
            return out

        return begun

    return ranked


@stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; null and blank texts do not. Columns named like a measure stay docs' own."""
    return quality.accepted(docs)


@stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first record of each group of texts linked by similar sets of word 5-grams; a text without words is a group of its own."""
    return jaccard_join.one_of_each(docs)


@stage(2)
def repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines, paragraphs and passages that an earlier one has; n_chars follows the text."""
    return substring_dedup.stripped(docs)


@stage(3)
def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; those without words are not."""
    return mixing.mixed(docs)


@stage(4)
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document; those of a null text are null."""
    with open(sp_tokens.MODEL, "rb") as f:
        return sp_tokens.encoded(docs, f.read()).select("doc_id", "ids", "n_tokens", "round_trip", "parity")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_units),
    ("mixing sources to target weights", target_weights),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL expresses neither the third stage nor the last; brute force tests all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
