"""Stages of the corpus pipeline; each works on all that the one before kept, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.decontaminate import clean
from papyrine.llm.feistel import shard
from papyrine.llm.mixing import mix
from papyrine.llm.odd_sketch import near_duplicates
from papyrine.llm.scratch import Scratch, kept_by
from papyrine.llm.toxicity import without_toxic

SHARDS = 40
#: Ids given to rows without one lie above all others.
HIGH = 1 << 62


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain finds toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: that of the smallest id, rows of null id last.

    Rows of null id are documents named by their text's hash.  Of rows that repeat an id, which are one
    document, the one with the smallest text hash stays.
    """
    scratch = Scratch(spark, "near-dedup")
    text = F.coalesce(F.xxhash64("text"), F.lit(0))
    high = text.bitwiseAND(F.lit(HIGH - 1)).bitwiseOR(F.lit(HIGH))
    key = F.coalesce(F.col("doc_id"), high)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", key.alias("key"))
    found = near_duplicates(keyed.select("key", "text"), id_col="key")
    dropped = scratch.table(found.where("not kept").select("key").distinct(), "dropped")
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    repeated = scratch.table(repeated, "repeated")
    left = kept_by(keyed, dropped, ["key"], "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    hashable = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(text, F.xxhash64(*hashable))
    several = kept_by(left, repeated, ["key"]).groupBy("key").agg(F.min_by("row", order).alias("row"))
    single = kept_by(left, repeated, ["key"], "left_anti")
    return single.select("row.*").unionByName(several.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents until each source has its target share of words."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all rows into shards; adds shard and slot.  Rows equal in id, source, language, size and text hash may swap."""
    hashed = docs.withColumn("__text_hash", F.xxhash64("text"))
    return shard(hashed, SHARDS, order=["doc_id", "source", "lang", "n_chars", "__text_hash"]).drop("__text_hash")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
