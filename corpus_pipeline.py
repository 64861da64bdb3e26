"""The corpus pipeline: documents through quality, near duplicates, decontamination, mixing and the token store.

Stages take and give whole rows of documents (doc_id, text, source and any further columns, whatever their names). Null and empty
texts, null and repeated ids and rows, and empty tables have the results that each stage names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import decontaminate, jaccard_join, mixing, quality, token_store
from claimspark.llm.common import discard, materialise, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject.

    Null and empty texts are scored as empty; every row counts for itself. Without usable labels all rows stay.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    The least doc_id stays, nulls last, of equal ids the least digest of the row. Texts without words link with nothing and
    stay, but for rows that are equal in every column.
    """
    return jaccard_join.near_duplicates(docs, all_without_id=False)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark; null and empty texts hold none, and without items all rows stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of their sources takes them; a null source is one of its own, equal rows are taken alike."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stored token sequences in training order; a text without ids has one sequence, that of the end alone."""
    return token_store.token_sequences(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: The network, the index search and the token store are no SQL; tests hold the stages and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next; what a stage has read is deleted after it."""
    docs, made = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        new = materialise(stage(spark, docs, sf_dir), name.split()[0])
        if made:
            discard(docs)
        docs, made = new, True
    return STAGES[-1][1](spark, docs, sf_dir)
