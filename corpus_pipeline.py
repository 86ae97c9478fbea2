"""The corpus pipeline: what low quality, repetition and benchmark leaks leave
of ``documents``, mixed to the sources' target weights and dealt into shards.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of
``documents`` (and any others that came with them, whatever their names).

Cases: texts that are null, empty or without words are rejected by the quality
stage; given to the later ones, they are one group of near-duplicates, hold no
benchmark item, are taken no times into the mix, and count one byte in a shard.
Very long texts are read whole. Rows that are equal in id and text are one for
the near-duplicate stage, alike for the quality and decontamination stages, and
taken one by one by the mix and the shards. Rows without an id are kept, but an
id comes first in a group. Empty tables pass through. Ties: of a group the row
with the smallest id stays; the mix breaks them by id, then by the row's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, mixing, quality, sharding, simhash
from lexmill.llm.common import Scratch, table, unused

N_SHARDS = 16


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    score = unused("lexmill_quality", docs)
    scored = quality.classify(docs, score_name=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies:
    five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each_group(docs, width=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy."""
    copies = unused("lexmill_copies", docs)
    mixed = mixing.mix_sources(docs, keep=docs.columns, copies_name=copies)
    repeated = mixed.withColumn(copies, F.explode(F.expr(f"CASE WHEN `{copies}` > 0 THEN sequence(1L, `{copies}`) ELSE array() END")))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it."""
    return sharding.shard_by_slots(docs, n_shards=N_SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot", "map_version")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Hash functions, model training and similarity groups have no SQL form; the
#: stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        scratch.keep(f"{k}_{name}")
    return docs
