"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention, media, mixing, packing, rules, simhash, suffixes, tokenfile, trees, urls
from .common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), digest=True)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read_table(spark, sf_dir, "documents"), length=400, words=51)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, distance=2)


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.store(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return tokenfile.read_back(files)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"))


def op6_mjpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read_table(spark, sf_dir, "documents"))


def op7_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    return mixed.withColumnsRenamed({"pw_replica": "replica", "pw_key": "shuffle_key"})


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(read_table(spark, sf_dir, "documents")).select(*columns)


def op10_attention_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.score(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_hilbert_packing,
        op2_suffix_array_dedup,
        op3_simhash_near_dedup,
        op4_token_file,
        op5_url_filter,
        op6_mjpeg_media,
        op7_boosted_quality,
        op8_poisson_mixing,
        op9_quality_rules,
        op10_attention_scoring,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_poisson_mixing": mixing.oracle(extra=", text, lang, n_chars"),
        "op9_quality_rules": rules.oracle(),
    }
