"""Queries of the llm problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import table
from .canonical import agent_phrases, map_rows, match_values
from .encoding import repair_encoding
from .mixing import mix_sources
from .packing import attach_text, pack_documents


# ---- 1: canonical list
def _agents(spark: SparkSession, d: str) -> DataFrame:
    return match_values(table(spark, d, "observations").select("user_agent"), "user_agent", table(spark, d, "ai_agents"), "token", agent_phrases)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose user agent names a listed agent."""
    rows = table(spark, d, "observations").where("user_agent IS NOT NULL").select("row_id", "user_agent")
    return map_rows(rows, "user_agent", _agents(spark, d)).select("row_id", F.col("entry").alias("token")).distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """User agents that name no listed agent, with their rows."""
    return _agents(spark, d).where("entry IS NULL").select("user_agent", "n_rows")


# ---- 7: containers
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers, for every capacity."""
    return pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """The containers with the texts that they hold."""
    return attach_text(p7_containers(spark, d), table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest conceivable, and the unused share, per capacity."""
    used = p7_containers(spark, d).where("container_id IS NOT NULL").groupBy("spec_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    specs = table(spark, d, "pack_specs")
    return used.join(specs, "spec_id").select(
        "spec_id", "purpose", "capacity_tokens", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("lower_bound"),
        F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )


# ---- 8: mixing
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix in which sources of four fifths of the target weight keep their share."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each listed source in that mix."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p8_exact_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source that has documents keeps its share."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"), full_weight=1.0, block=64)[0]


def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of that mix."""
    return mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"), full_weight=1.0, block=64)[1]


# ---- 9: encoding
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold wrongly decoded text."""
    return repair_encoding(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """These documents with the restored text."""
    return repair_encoding(table(spark, d, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unmatched, p7_containers, p7_texts, p7_fill, p8_exact_mix, p8_exact_shares, p8_mix, p8_shares, p9_found, p9_restored)
}
SQL: dict[str, str] = {}
