"""A corpus pipeline over documents: quality, exact and near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import Scratch, table

STAGES = [
    ("quality", stages.keep_good),
    ("exact_dedup", stages.drop_copies),
    ("ngram_jaccard", stages.drop_near_copies),
    ("mixing", stages.mix_sources),
    ("packing", stages.pack_sequences),
]

#: Classifier, near-duplicate join, draws and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again before the next one."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
