"""From documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a frame, which is written as Parquet and read again for the next
one. All stages but the last return the columns of documents.

1. quality: documents that the quality rules reject go.
2. exact: of equal texts (A-Z lower-cased) the one with the largest id stays.
3. near: of each group of near duplicates the one with the smallest id stays.
4. mix: documents as the mix of sources takes them; one row for each time, its
   text made of the words taken then.
5. encode: adds ``ids``, the SentencePiece ids of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logfathom.llm import exact_dedup, mixing, near_dedup, pieces, quality
from logfathom.llm.tables import documents
from logfathom.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.default_model())


STAGES = [
    ("quality", quality_rules),
    ("exact", exact_copies),
    ("near", near_copies),
    ("mix", source_mix),
    ("encode", token_ids),
]

# SQL cannot express the sketches, permutations and merges of stages 3 to 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
