"""Registered queries of the general data-quality problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.operators import orphans
from gritstone.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.dangling_imports(*(table(spark, sf_dir, t) for t in ("edges", "files", "removed_files")))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.dangling_rates(*(table(spark, sf_dir, t) for t in ("edges", "files", "removed_files")))


QUERIES = {f.__name__: f for f in (p4_found, p4_rates)}

ORACLE_SQL: dict[str, str] = {}
