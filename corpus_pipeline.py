"""The corpus pipeline: quality rules, near duplicates, source mixing, packing; each stage on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import mixing, packing, quality, setsketch
from tidegrid.llm.common import table, written
from tidegrid.llm.queries import END_ID


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. The trusted text is that of the labelled documents among docs.

    Null and empty texts, and those under 20 words, go. Null ids and repeated rows are judged like others; all columns stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 over shingles of five words.

    Documents without words link with nothing and stay, as do rows with a null id. Of rows that share an id one stays.
    """
    return setsketch.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: repeated where it takes them more than once, cut to words where it takes a part, gone where none.

    Documents without words go. Sources are ranked by code point, a null source last. Null ids and repeated rows are
    documents like others. No rows give no rows.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    A null or empty text is the end id alone. Null and repeated ids are documents of their own; other columns go.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, 1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Hashed models, sketches and a tokenizer: not SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
