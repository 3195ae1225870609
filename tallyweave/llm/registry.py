"""The queries of this folder, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import (alignment, decontaminate, fingerprint, kdshards, main_text, neardup, pieces, pseudonym, quality, quotes,
                            spelling, url_filter, warc)
from tallyweave.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_fingerprints(table(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonym.with_pseudonyms(docs)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), 4, 80)


def op7_reply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled(table(spark, sf_dir, "documents"), 2, spell=True)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.with_main_text(pages, main_text.learn(pages))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshards.sharded(table(spark, sf_dir, "documents"), 24)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.summed(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_main_text": op2_main_text,
    "op3_url_rules": op3_url_rules,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_quality": op5_quality,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_reply_order": op7_reply_order,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_warc": op9_warc,
    "op10_contaminated": op10_contaminated,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_kd_shards": op12_kd_shards,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op3_url_rules": url_filter.SQL,
    "op7_reply_order": quotes.SQL,
    "op9_warc": warc.SQL,
    "op10_contaminated": decontaminate.SQL,
}
