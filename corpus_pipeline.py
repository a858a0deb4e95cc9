"""A corpus pipeline over documents: quality rules, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first four return
the columns of documents, whatever they are named; packing returns one row per packed piece. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import lsm_dedup, mixing, outliers, packing, simhash
from lodestack.llm.common import documents, staged
from lodestack.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust outlier test rejects.

    A null or empty text has no words and goes; null languages and sources are groups of their own; rows that share a doc_id go together.
    """
    return outliers.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text, white space aside: the one with the most code points, then the smallest doc_id.

    Null counts as empty text, a null doc_id comes last, and of rows that repeat one (doc_id, text) one stays.
    """
    return lsm_dedup.keep_unique(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id; rows that share a doc_id stay or go together.

    A text without words has fingerprint zero like any other such text; a null doc_id goes if its component has another.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them: whole times, then a leading part of the text once more.

    A text without words is taken no times; null is a source of its own, the last; rows that repeat a doc_id get the same share.
    """
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the token ids; a null or empty text is its end-of-document id alone, and each row is packed by itself."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can state neither the outlier test nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
