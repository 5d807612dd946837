"""From raw documents to packed training sequences: five stages, each an operator of lakeforge.llm.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeforge.llm import decontam, linededup, lshforest, packing, quality
from lakeforge.llm.common import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go; so do documents that the base rules fail or that lost too much."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return linededup.dedup(docs, Workspace(spark, "lines"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, and all texts without words."""
    return lshforest.dedup(docs, Workspace(spark, "forest"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of neighbours along the curve; one row a piece."""
    return packing.pack(docs, Workspace(spark, "packing"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequence_packing),
]

#: Tokenization and the near-duplicate components can't be put in SQL; tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = list(Workspace.opened)
        docs = ws.write(stage(spark, docs, sf_dir), f"stage-{k}")
        for scratch in [x for x in Workspace.opened if x not in before]:
            scratch.close()  # the stage's own tables
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
