"""Cleaning of a training corpus, a stage after the other over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents, whatever further ones these have. Rows without a doc_id or a text go the same way as others (a
null text as the empty one); repeated rows are kept by all stages but that of near copies, which keeps one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from rallyframe.llm.runtime import columns, free_name, remove, shared_dir, stored, table

#: Toxicity is learned and lines are hashed to 128 bits; SQL has no counterpart of the first.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, with a model fitted on the labelled ones.

    Without labelled documents of both kinds there is nothing to tell them apart by, and all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not model.weights:
        return docs
    name = free_name(docs, "score")
    scored = toxicity.score_documents(docs, model, name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*columns(docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many repeat; n_chars follows the text.

    A text whose lines all go is empty; ties between documents go to the largest doc_id; a null text stays null.
    """
    names = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    out = line_dedup.dedup_lines(docs, count_names=names)
    n_chars = F.when(F.col(names[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*columns(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies, null last; of repeated rows one.

    Texts without words are copies of each other.
    """
    return simhash.keep_one_of_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts and items match nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, and whether they decode to the text's bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is a table in the shared folder until the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/{name}"
        docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
