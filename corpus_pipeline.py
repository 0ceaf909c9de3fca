"""Corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import bpe, exact_dedup, language_id, mixing, simhash
from stratakv.llm.common import materialize, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts, texts without a letter, and texts farther from every language's codeword than any labelled one."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    found = language_id.identify(rows, language_id.train(docs), keep=("row",))
    return found.where("accepted").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by reachability within 4 fingerprint bits, the document with the smallest id stays.

    Rows of one id are told apart by their texts; rows without an id stay.
    """
    return simhash.kept_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row, as many times as the mix took it; an empty text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest id stays, once; rows without an id stay."""
    return exact_dedup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its source's budget takes it (up to 3 times, perhaps not at all); rows without words go."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", keep_identified),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE", encode),
]

#: The language model of stage one and the fingerprints of stage three are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
