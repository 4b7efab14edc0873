"""Queries of problems 2, 5, 6, 7 and 8 with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phylospan.llm import leakage, packing, pii, species, tokenise
from phylospan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.match_species(table(spark, sf_dir, "first_div_output"), table(spark, sf_dir, "species_list"))


def p5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "seq_lengths"), table(spark, sf_dir, "db_builds"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.encode_documents(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL: dict[str, str] = {}

QUERIES: dict[str, Query] = {
    "p2_found": p2_found, "p5_packing": p5_packing, "p6_ids": p6_ids, "p7_found": p7_found,
    "p8_found": p8_found, "p8_redacted": p8_redacted,
}
