"""The corpus pipeline: documents through five operators of `larder.llm`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, mixing, sharding, simhash, toxicity
from larder.llm.common import fresh, materialise, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the scorer learns from `labels` and the stage's own documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.fit(docs, toxicity.train_labels(labels, "toxic"))
    score = fresh(["llm_toxicity"], docs.columns)[0]
    return toxicity.toxicity_scores(docs, scorer, score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate takes it."""
    return mixing.mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and slot, with size and CRC."""
    d = sharding.shard_rows(docs, shards=16)
    return d.select("doc_id", "sharding.size", "sharding.text_crc32", "sharding.shard", "sharding.slot")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic), ("simhash_neardup", drop_near_copies), ("decontamination", drop_contaminated),
    ("source_mixing", mix), ("sharding", shard)]

# A trained model and XXH64 fingerprints have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next.

    Null and empty texts are kept by every filter and have no words; a row
    without a doc_id can't be a copy's name and stays. Rows that repeat are rows
    each, until the near-duplicate stage leaves one. A table without rows gives
    no rows, and other columns pass through whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            release(before)  # nothing reads the stage's input any more
    return docs
