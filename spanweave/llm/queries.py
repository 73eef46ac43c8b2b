"""Queries p6 to p8, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import encode, leaks, spans
from spanweave.plans.registry import Registry
from spanweave.runtime import load

R = Registry()


@R.add("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(load(spark, d, "documents"), "doc_id", "text")


@R.add("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(load(spark, d, "documents"), load(spark, d, "eval_items"))


@R.add("p7_kept")
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_leaks(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_items")).select("doc_id")


@R.add("p7_cleaned")
def p7_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leaks.without_passages(load(spark, d, "documents"), load(spark, d, "eval_items"))


@R.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(load(spark, d, "documents"))


@R.add("p8_share")
def p8_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(load(spark, d, "documents"))
