"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    from papyrine.llm.odd_sketch import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from papyrine.llm.multi_index import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of rules and host reputation for every page."""
    from papyrine.llm.host_reputation import judge, page_outcomes

    pages = _read(spark, sf_dir, "pages")
    judged = judge(pages, page_outcomes(pages, _read(spark, sf_dir, "labels")))
    return judged.withColumns({"page_id": F.col("page_id").cast("bigint")} | {c: F.round(c, 9) for c in ("host_rate", "host_lower")})


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC transactions and read back, a row per capture."""
    from papyrine.llm.warc import warc_digest

    return warc_digest(_read(spark, sf_dir, "pages"))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all sources."""
    from papyrine.llm.mixing import mix_digest

    return mix_digest(_read(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every line, and which line of it stays."""
    from papyrine.llm.fuzzy_lines import dedup_lines

    return dedup_lines(_read(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    from papyrine.llm.feistel import shard_digest

    return shard_digest(_read(spark, sf_dir, "documents"))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a load, a recount and a withdrawal."""
    from papyrine.llm.token_rollup import maintain

    return maintain(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found inside documents."""
    from papyrine.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities and verdict of every document."""
    from papyrine.llm.toxicity import judge_toxicity

    return judge_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: those of the rules and those of the network."""
    from papyrine.llm.secret_network import secret_digest

    return secret_digest(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes, by language, order and step."""
    from papyrine.llm.filter_audit import audit_documents

    return audit_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of every vector."""
    from papyrine.llm.hamerly import cluster

    return cluster(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    found = [op1_odd_sketch, op2_multi_index, op3_host_reputation, op4_warc_transactions, op5_water_filling, op6_fuzzy_lines, op7_feistel_shards, op8_token_rollup, op9_containment_search, op10_classifier_chain, op11_secret_network, op12_filter_audit, op13_hamerly]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    from papyrine.llm.oracle import SQL

    return dict(SQL)
