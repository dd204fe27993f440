"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``docs``, whatever further columns there are and however they are named; an empty table gives an empty
result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litweave.llm.common import cut, table
from litweave.llm.minhash import one_of_each
from litweave.llm.mixing import mixed
from litweave.llm.packing import pack
from litweave.llm.secrets import mask_secrets
from litweave.llm.toxicity import clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts score as texts without words, and so stay unless the model rejects those. Rows that share an id
    are scored each for itself. Without labels all rows stay.
    """
    return clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    Null texts, texts without words and rows without an id are in no group; of those with one id and no words one stays.
    Unlike texts that share an id are documents of their own; of equal rows one stays.
    """
    return one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds; every row stays, null and empty texts as they are."""
    return mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it, at most twice.

    Null texts and texts without words are not in the mix; null is a source of its own. Rows that share an id are
    documents of their own.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences; a null or empty text is one piece of one token."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the sketches and the tokenizer have no form in SQL; tests hold each stage against plain Python
#: (``tests/llm/test_brute.py``).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
