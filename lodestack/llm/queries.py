"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import conversations, fm_index, lsm_dedup, mil_quality, minhash, mixing, outliers, packing, secrets, simhash, spelling, toxicity, url_filter
from lodestack.llm.common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(documents(spark, sf_dir))


def op2_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsm_dedup.exact_dedup(documents(spark, sf_dir))


def op3_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op5_fm_index_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op8_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op9_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")


def op11_gram_index_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


def op12_lattice_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_fast_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mcd_quality_rules,
        op2_lsm_exact_dedup,
        op3_water_filling_mix,
        op4_tier_packing,
        op5_fm_index_substrings,
        op6_boosted_toxicity,
        op7_secret_battery,
        op8_simhash_bk_trees,
        op9_attention_mil_quality,
        op10_url_rules,
        op11_gram_index_spelling,
        op12_lattice_repair,
        op13_fast_sketch_minhash,
        pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_lsm_exact_dedup": lsm_dedup.ORACLE_SQL,
    "op3_water_filling_mix": mixing.ORACLE_SQL,
    "op5_fm_index_substrings": fm_index.ORACLE_SQL,
    "op13_fast_sketch_minhash": minhash.ORACLE_SQL,
}
