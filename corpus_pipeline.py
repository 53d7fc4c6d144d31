"""A corpus from documents to packed sequences: quality, near-duplicates, mixing, packing.

Each stage takes the rows that the stage before it kept and decides on them alone. Null and repeated
ids, repeated rows, null, empty and very long texts, columns of any further name and empty tables go
through; what each stage makes of them is stated there."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bookreplay.llm import mixing, packing, quality, simhash
from bookreplay.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep, row by row: equal rows stay or go alike.
    Null and empty texts have no words and go. A score at the threshold stays. An empty table stays empty."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id (null last; among rows of one
    id that with the smallest hash of id and text). Rows with null or repeated ids stay where their texts
    are like no other's; of equal rows one stays. An empty table stays empty."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: none, once or twice. Null sources are one source;
    rows with equal ids and texts are taken alike. An empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens. A null or empty text is its end id alone; repeated
    rows give repeated pieces, and which of equal pieces takes which of equal places follows from id and
    piece. An empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [("quality", quality_rules), ("near_duplicates", simhash_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Token ids, and which of the equal places a piece takes, are beyond SQL; tests hold the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
