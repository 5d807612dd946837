"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hpylm, linededup, lshforest, packing, pii, quality, resharding, secrets, warc
from .common import Workspace, table
from .oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).drop("cleaned")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), Workspace(spark, "pii"))


def op4_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, manifest = warc.write(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    return warc.read(spark, archive, manifest)


def op5_hpylm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"), Workspace(spark, "hpylm"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"), Workspace(spark, "lines"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"), Workspace(spark, "secrets"))


def op8_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = resharding.read(resharding.transfer(table(spark, sf_dir, "documents"), Workspace(spark, "shards")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block", "moved")


def op9_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.cluster(table(spark, sf_dir, "documents"), Workspace(spark, "forest"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Workspace(spark, "packing"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_benchmark_decontamination,
        op3_pii_surrogates,
        op4_warc_shards,
        op5_hpylm_scores,
        op6_line_dedup,
        op7_secret_scan,
        op8_min_cost_resharding,
        op9_minhash_lsh_forest,
        op10_hilbert_packing,
    )
}
