"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source weights, packing.

Each stage is written as Parquet and read again before the next: a lost executor costs at most the stage at hand.

In all stages a null text reads as the empty one, null ids and repeated rows are rows like any other, an empty table gives
an empty one, and columns besides doc_id, text, source and n_chars are passed on whatever their names; the last stage
returns pieces and not these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import mixing, packing, rules, simhash, suffixes
from pagewright.llm.common import cut, read_table, recorded, release
from pagewright.llm.queries import tokenizer_file
from pagewright.session import give_package

#: Repeated passages of this many bytes are removed, and shorter ones of so many words: all of over 50.
PASSAGE_BYTES = 300
PASSAGE_WORDS = 51


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: texts under 50 words, null and empty ones among them, go."""
    return rules.sift(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more, that with the least doc_id, a null id
    after all others; of rows that repeat both doc_id and text one."""
    return simhash.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that recur in the same or another document; n_chars is counted anew."""
    return suffixes.stripped(docs, PASSAGE_BYTES, PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's target weight, shuffled; a null source is a source of its own."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; an empty text is its end id alone."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), digest=True)


#: Name and scratch tables of the stage that ran last. Once its result is written, as it is when the next begins, they go.
_last: tuple[str, list[str]] = ("", [])


def _stage(f: Stage, before: Stage | None) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        give_package(spark)
        if before and _last[0] == before.__name__:
            release(spark, _last[1])
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _last = f.__name__, made
        return out

    return run


_ORDER = (quality_rules, near_dedup, suffix_dedup, mix_sources, pack_sequences)
STAGES = [(f.__name__, _stage(f, before)) for f, before in zip(_ORDER, (None, *_ORDER[:-1]), strict=True)]

#: Hamming links over XXH64, suffix sorting and subword ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
