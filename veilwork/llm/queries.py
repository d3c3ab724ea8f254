"""The registered queries of the operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilwork.llm import chat, decontam, htmltext, langid, licenses, mixing, phrases, quality, shards, simhash, subwords, surrogates, turns

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).drop("n_lines", "host_rate")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard(_table(spark, folder, "documents"))


def op4_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.pseudonymise(_table(spark, folder, "documents"))


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, folder, "documents"))


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents"))


def op7_chat_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.expand_prefixes(turns.unionByName(extra)))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op9_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.main_text(_table(spark, folder, "pages"))


def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op11_subwords(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    return subwords.digests(subwords.encode(_table(spark, folder, "documents"), path("piece_bpe_32k.model")))


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, folder, "documents"))


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_digests(turns.damaged(_table(spark, folder, "conversations")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_host_quality,
        op2_decontamination,
        op3_minimax_shards,
        op4_pii_surrogates,
        op5_license_scan,
        op6_source_mix,
        op7_chat_prefixes,
        op8_language,
        op9_main_text,
        op10_simhash_groups,
        op11_subwords,
        op12_phrases,
        op13_turn_repair,
    )
}
ORACLES: dict[str, str] = {"op1_host_quality": quality.ORACLE, "op2_decontamination": decontam.ORACLE, "op7_chat_prefixes": chat.ORACLE, "op12_phrases": phrases.ORACLE}
