"""A training corpus from raw documents: five stages of the operators in resgov.llm.

Toxic documents go; of near copies one stays; personal data is covered; sources
are mixed to their target weights (a document may come twice); what is left is
encoded in pieces.  Every stage reads what the one before wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from resgov.llm import factor_machine, pieces, pii
from resgov.llm.frames import free_name, prepared, written
from resgov.llm.mixing import mixed_documents
from resgov.llm.near_dedup import survivors
from resgov.llm.queries import MODEL_FILE, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine predicts to be toxic go.

    The machine learns from the labelled rows among docs that are not held out.
    """
    prepared(spark)
    machine = factor_machine.fit_machine(docs, read(spark, sf_dir, "labels"))
    return factor_machine.without_toxic(docs, machine)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8 or more) one row stays: of the smallest doc_id, then any of its rows.

    Repeated rows are copies of each other; a null doc_id stays only if its group has
    no other; rows without words all stay.
    """
    prepared(spark)
    row = free_name("row", docs.columns)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return rows.join(survivors(rows, row, k=5, percent=80), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind in angle brackets; n_chars follows the text."""
    prepared(spark)
    covered = pii.redacted(docs, pii.fit_choosers(docs))
    return covered.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else covered


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    prepared(spark)
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns but text, and the N best segmentations: n_pieces, score and ids of the best, the alternatives, whether it decodes to the text."""
    prepared(spark)
    return pieces.corpus(docs, MODEL_FILE)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None  # learned scores, similarity and random rounding are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread as the next one's docs."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
