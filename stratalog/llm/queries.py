"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_collapse, conflict_packing, contiguous_shards, decision_list, decontaminate, partenum_join, quality_ftrl, repair_tokens, toxicity_rnn, warc_derivatives
from .store import table


def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contiguous_shards.query(table(spark, sf_dir, "documents"))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.query(table(spark, sf_dir, "conversations"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.query(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.query(table(spark, sf_dir, "pages"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_packing.query(table(spark, sf_dir, "documents"))


def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum_join.linked(table(spark, sf_dir, "documents"))


def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_rnn.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op9_ftrl_quality": op9_ftrl_quality,
    "op6_minimax_shards": op6_minimax_shards,
    "op3_snapshot_collapse": op3_snapshot_collapse,
    "op5_decision_list": op5_decision_list,
    "op1_repair_tokens": op1_repair_tokens,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op2_template_decontamination": op2_template_decontamination,
    "op10_conflict_packing": op10_conflict_packing,
    "op4_partenum_jaccard": op4_partenum_jaccard,
    "op8_bigru_toxicity": op8_bigru_toxicity,
}

ORACLES: dict[str, str] = {
    "op3_snapshot_collapse": chat_collapse.SQL,
}
