"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import bpe, linededup, mixing, quality, simhash
from trailmark.llm.common import mark, release, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", bpe.stage),
]

#: Boosted trees, winnowing and XXH64 have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; of what they write, the last stage's table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        release(spark, since, keep_last=True)
    return docs
