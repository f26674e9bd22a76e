"""The queries ``opN_<name>``: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .chat_format import Template, formatted_and_read
from .classifier import classify_quality
from .decontaminate import decontaminate
from .language_id import identify_languages
from .lm_score import lm_scores
from .mix import mix
from .near_dedup import near_duplicates
from .phrases import mine_phrases
from .quality_rules import quality_rules
from .shard import lookup_table, place, shard_names
from .substring_dedup import substring_dedup
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to archives and read back."""
    records = read_archives(write_archives(_table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return place(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, whose texts are control strings, formatted, written and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return formatted_and_read(rows.unionByName(more))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that don't depend on its model, for the comparison with SQL."""
    return op6_quality_rules(spark, sf_dir).drop("kept", "probability")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_near_dedup, op2_decontaminate, op3_warc, op4_shard, op5_mix, op6_quality_rules, op7_lm_score, op8_quality_classifier, op9_language_id, op10_substring_dedup, op11_chat_format, op12_phrases, rule_counts)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": sql.NEAR_DEDUP, "op2_decontaminate": sql.DECONTAMINATE, "op3_warc": sql.WARC, "op4_shard": sql.shard(lookup_table(shard_names())), "rule_counts": sql.RULE_COUNTS, "op5_mix": sql.MIX, "op10_substring_dedup": sql.SUBSTRING_DEDUP, "op11_chat_format": sql.chat_format(Template()), "op12_phrases": sql.PHRASES}
