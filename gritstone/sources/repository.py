"""Reading repositories, stored results and accepted findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.scalar import glob_regex

# Folders that hold no source of the repository itself.
EXCLUDED = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/.expo/**", "**/android/**", "**/ios/**", "**/.git/**")


def text_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(rel, text, size, mtime, content_hash) of the UTF-8 files under a folder, in any file system Spark reads.

    Listing and reading are distributed; excluded paths are dropped before their
    content is read, files that are no UTF-8 after it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/") + "/", "")
    rows = files.withColumn("rel", rel).filter(~F.col("rel").rlike("|".join(map(glob_regex, exclude)))) if exclude else files.withColumn("rel", rel)
    rows = rows.filter(F.is_valid_utf8(F.col("content").cast("string")))
    mtime = F.unix_micros("modificationTime") * 1000
    return rows.select("rel", F.col("content").cast("string").alias("text"), F.col("length").alias("size"), mtime.alias("mtime"), F.sha2("content", 256).alias("content_hash"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted findings: a JSON document with a list of entries."""
    entry = "array<struct<id: string, rule: string, file: string, reason: string, author: string, date: string, severity: string>>"
    rows = spark.read.schema(f"version string, entries {entry}").json(path, multiLine=True)
    return rows.select(F.explode("entries").alias("e")).select("e.*")


def write_baseline(entries: DataFrame, path: str) -> None:
    """Accepted findings in order of their ids, one JSON line each, for any number of them."""
    entries.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


def latest_labels(rows: DataFrame) -> DataFrame:
    """The last label of each pair (pair_key, seq, label)."""
    return rows.groupBy("pair_key").agg(F.max_by("label", "seq").alias("label"))
