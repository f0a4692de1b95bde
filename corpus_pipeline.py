"""A training corpus from documents: five filtering stages, each written and read again by the next.

Every stage takes the session, the documents its predecessor kept, and the
folder of the tables; all but the last return rows with the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm import containment, line_chunks, pieces, similar_texts, toxicity
from tablecare.llm.queries import table
from tablecare.sources.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorization machine rejects; it learns from the labels of the given documents."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks stay in the first document that has them; n_chars follows the text."""
    done = line_chunks.remove_repeats(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in done.columns else done


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones."""
    return similar_texts.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return containment.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text."""
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_chunks", drop_repeated_lines),
    ("similar_texts", drop_similar),
    ("containment", drop_leaks),
    ("pieces", encode),
]

#: SQL can express neither the machine's training nor the tokenizer; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
