"""The registered queries of the corpus operators, each over whole tables with production parameters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowlark.llm import chat, html_template, jaccard, licences, oracles, packing, prefix_trie, quality, rules, secret_scan, sharding, tiling, token_counts, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.find_licences(_table(spark, sf_dir, "documents"))


#: The contract's extra conversation: control strings and escapes inside both texts.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = json.dumps({"prompt": PROBE_TEXT, "completion": PROBE_TEXT})
    extra = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(probe).alias("record"))
    return chat.digests(chat.format_records(chat.conversation_records(rows, varied=True).unionByName(extra))).drop("fingerprint")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hilbert_shards, op2_secret_scan, op3_ngram_jaccard, op4_benchmark_tiling, op5_quality_classifier, op6_html_templates, op7_quality_rules, op8_best_fit_packing, op9_licence_scan, op10_chat_formatting, op11_prefix_trie, op12_token_counts, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
