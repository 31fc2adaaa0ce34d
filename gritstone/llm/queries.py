"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import components, credentials, mixture, provenance, reading, simjoin, syntax, tokens
from gritstone.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.found_groups(table(spark, sf_dir, "candidate_pairs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.found_pairs(table(spark, sf_dir, "function_records"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.linked_classes(table(spark, sf_dir, "function_records"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.foreign_files(table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "files"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.labelled_files(table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_files(table(spark, sf_dir, "parsed_files"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_rates(table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "files"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.found_secrets(table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "findings"))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted_texts(table(spark, sf_dir, "parsed_files"), table(spark, sf_dir, "findings"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = checkpointed(mixture.document_sizes(table(spark, sf_dir, "documents")))
    targets = table(spark, sf_dir, "mix_targets")
    return mixture.mixture(sizes, targets), sizes, targets


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.shares(*_mixed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.hard_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_classes, p3_found, p3_labels, p5_found, p5_rates, p6_found, p6_redacted, p7_ids, p8_mixture, p8_shares, p9_found, p9_levels)
}

ORACLE_SQL: dict[str, str] = {}
