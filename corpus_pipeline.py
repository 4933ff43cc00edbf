"""A training corpus from raw documents, stage by stage.

Each stage takes the documents its predecessor kept and returns documents with the
same columns; the last one returns the token ids' index.  ``run`` writes every
stage's result as a table in the shared folder and reads it again, so a lost
executor never costs more than a stage; what a stage has read is dropped once its own
result is written.

Defined results, of every stage: an empty table gives an empty table, and an empty
benchmark, or labels that don't have both values, change nothing; null texts, and empty
ones, are never toxic, near copies or contaminated, have size 0 and one token; null ids
are kept and stand alone; repeated rows are treated alike, but for mixing, where a budget
may end between them; columns besides the documents' own pass through, whatever their
names; very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, minhash, mixing, tokens, toxicity
from millrace.llm._session import checkpointed, discard, shared_folder
from millrace.llm.queries import held_out, table, word_tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity network rejects: a score of 0.7 or more.
    Without labels of both kinds none goes."""
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return toxicity.reject(docs, network)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id: five-word
    shingles, similarity 0.8.  Rows of that id all stay; documents without words or id do."""
    return minhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of the benchmark, ten words or whole items; the rest of each
    document stays, and a document of which no word is left goes."""
    return decontam.remove_passages(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it: not at all, or up to three
    times; documents of size 0 go with the ones that they stand before in the order."""
    return mixing.take(mixing.mix(docs))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Simple-8b blocks, and from them each document's place; a document that
    is there several times has as many rows."""
    return tokens.tokenize(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: Trained models and tokenizers can't be written in SQL; a test compares all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name)
        docs = checkpointed(stage(spark, docs, sf_dir), folder=folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
