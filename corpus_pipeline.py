"""The corpus pipeline: stages that each read the written result of the one before.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import exact_blocks, mixing, packing, simhash_grid, toxicity
from tidewire.llm.queries import PACKING_TOKENIZER
from tidewire.session import discard_materialised, materialise, written_so_far


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learned from the labels scores below its threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id."""
    return exact_blocks.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of two or fewer differing bits."""
    return simhash_grid.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, each with its sequence and place."""
    return packing.pack_documents(docs, PACKING_TOKENIZER).withColumnRenamed("id", "doc_id").drop("row")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

# Tokens and fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; once a stage's rows are written, what led to them is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = written_so_far()
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        before = written_so_far()
        docs = materialise(found, f"pipeline-{name}")
        discard_materialised(spark, start, before)
    return docs
