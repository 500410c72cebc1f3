"""Cleans the corpus in stages; each stage is written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.common import stored
from tabloom.llm.decontaminate import drop_contaminated
from tabloom.llm.exact_dedup import drop_exact_copies
from tabloom.llm.language import drop_unidentified
from tabloom.llm.pieces import encode_documents
from tabloom.llm.queries import table, tokenizer_file
from tabloom.llm.simhash import drop_near_copies

ORACLE_SQL = None     # fingerprints, models and alignments have no SQL; the stages are tested against plain versions


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on the labelled ones, can tell."""
    return drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every group of identical texts."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: fingerprints over five words that differ in at most five bits."""
    return drop_near_copies(docs, words=5, max_bits=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and whether they decode back to its text."""
    return encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("decontamination", benchmark_leaks), ("token ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one makes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
