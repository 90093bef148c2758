"""From documents to packed training sequences: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varispark.llm import language_id as languages
from varispark.llm import line_dedup as lines
from varispark.llm import mixing, near_copies, packing
from varispark.llm.shared import Scope, materialize, table, unused
from varispark.llm.tokens import tokenizer_path

#: The language parse and the packing's tokenizer can't be written in SQL.
ORACLE_SQL = None
#: Intermediate tables of the stage called last: its result has been written when the next one begins.
_last = Scope()


def stage(function):
    """Ends the scope of the stage called before, and gives this one its own."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        _last.end()
        _last = Scope()
        with _last:
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    return languages.keep_known(docs, languages.fit(docs, learn=F.lit(True)))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their sources; n_chars follows the text."""
    p = unused("__stage", docs)
    cleaned = lines.clean(docs, F.col("source"), counts=(f"{p}_n", f"{p}_dropped"))
    size = F.when(F.col(f"{p}_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more."""
    return near_copies.keep_first(docs)


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.stream(docs)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), 2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, with a written table between any two; only the last one's stays, and is returned."""
    global _last
    docs, held = table(spark, sf_dir, "documents"), Scope()
    for name, function in STAGES:
        result, now = function(spark, docs, sf_dir), Scope()
        with now:
            docs = materialize(result, f"stage-{name}")
        held.end()
        held = now
    _last.end()
    _last = Scope()
    return docs
