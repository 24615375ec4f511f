"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Rejects toxic documents, keeps one of each group of equal texts, keeps one of each group of near
copies, drops documents that contain a test item, and mixes what is left to source targets. All
stages but the last return the columns of their input; the last adds size, target and words taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm.common import materialize
from rangeloom.llm.decontam import decontamination_stage
from rangeloom.llm.exact import exact_stage
from rangeloom.llm.mixing import mixing_stage
from rangeloom.llm.simhash import simhash_stage
from rangeloom.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The stages learn a classifier, hash and search: SQL can't express them. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the mix. Tables between the stages are in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
