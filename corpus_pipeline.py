"""Corpus pipeline: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every result is written as Parquet and
read again. All stages but the last return the columns of documents, and other columns of the input are left out at once,
whatever their names.

Null and empty texts: scored like any other text; near duplicates of each other; unchanged by the removal of passages (null
stays null); of size 0 in the mix; packed as their final id. A null doc_id trains nothing, is no near duplicate, and is
carried. A null source is a source of its own. Very long texts are worked on whole. Ties: of equal texts the smallest doc_id
stays; sources of equal target go by name. Rows that repeat with the same doc_id stay or leave together, repeat each other's
passages, get the same number of copies, and are packed each. An empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import gam, packing, replication, simhash, suffix_dedup
from loamstone.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gam.keep_good(docs.select(*COLUMNS), labels, gam.fold() != 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return simhash.near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand anywhere else too go; characters cut in two go whole. Documents all stay.

    A passage is what 160-byte strings cover that start at two places (50 words of two letters, and the spaces, have 149).
    """
    return suffix_dedup.without_repeats(docs.select(*COLUMNS), length=160, least_words=50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come to their target weights, in shuffled order."""
    return replication.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with the ids themselves."""
    return packing.pack(docs.select("doc_id", "source", "text"), packing.tokenizer_path(), carry_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("source_mix", source_mix), ("packing", packed)]

ORACLE_SQL = None  # trained models, byte windows and BPE ids are not in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    last = None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs.select(*[F.col(c) for c in docs.columns])
