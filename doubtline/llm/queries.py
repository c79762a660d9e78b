"""Registered queries of the text operators, next to the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doubtline.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    html_text,
    lexical,
    mixing,
    quality,
    repetition,
    sharding,
    simhash,
    substrings,
    token_counts,
    toxicity,
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_repetition_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition_rules(_table(spark, sf, "documents"))


def op2_repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return quality.score_quality(docs, quality.train(docs, _table(spark, sf, "labels")))


def op4_hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf, "documents"))


def op5_simhash_golay(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(_table(spark, sf, "documents"), path, pattern), path, pattern))


def op7_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_restored_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf, "labels"), toxicity.char_model(docs)))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op12_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damage(_table(spark, sf, "conversations"))))


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repetition_rules,
        op2_repeated_substrings,
        op3_subword_quality,
        op4_hash_tree_shards,
        op5_simhash_golay,
        op6_byte_bpe,
        op7_benchmark_leaks,
        op8_restored_toxicity,
        op9_token_counts,
        op10_html_main_text,
        op11_lexical_search,
        op12_source_mix,
        op13_conversation_repair,
    )
} | {"pipeline": corpus_pipeline.run}


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def sql() -> dict[str, str]:
    known = {
        "op1_repetition_rules": repetition.rules_sql(),
        "op4_hash_tree_shards": sharding.shards_sql(),
        "op11_lexical_search": lexical.SQL,
        "op12_source_mix": mixing.mix_sql(),
        "op13_conversation_repair": conversations.repair_sql(),
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: statement for name, statement in known.items() if statement}
