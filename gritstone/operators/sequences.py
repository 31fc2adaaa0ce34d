"""Ordered operators: runs, resets, histories, changes and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, order: list[str], value: str, least: int) -> DataFrame:
    """Unbroken runs of one value: (key, value, first, length) of at least ``least`` rows."""
    w = Window.partitionBy(key).orderBy(*order)
    v = Window.partitionBy(key, value).orderBy(*order)
    island = rows.withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    out = island.groupBy(key, value, "island").agg(F.min(order[-1]).alias("first"), F.count("*").alias("length"))
    return out.filter(F.col("length") >= least).select(key, value, "first", "length")


def counted_with_reset(rows: DataFrame, key: str, order: list[str], up: Column, reset: Column, cap: int) -> DataFrame:
    """A counter per key after each row: +1 on ``up``, 0 on ``reset``; beyond ``cap`` the key is silent for good."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("epoch", F.sum(F.when(reset, 1).otherwise(0)).over(w))
    e = Window.partitionBy(key, "epoch").orderBy(*order)
    n = F.sum(F.when(up, 1).otherwise(0)).over(e)
    counted = marked.withColumn("round", F.least(n, F.lit(cap))).withColumn("over", n > cap)
    return counted.withColumn("silent", F.max("over").over(w)).drop("epoch", "over")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ``order`` must tell rows apart. A partially aggregated maximum, so a hot key is no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*[c if c in keys else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def newly(current: DataFrame, previous: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, known) of items that were not there before; known says whether the key has a history at all."""
    new = current.select(key, item).distinct().join(previous.select(key, item).distinct(), [key, item], "left_anti")
    history = previous.select(key).distinct().withColumn("known", F.lit(True))
    return new.join(history, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def changed(now: DataFrame, before: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, change): added, changed or gone by hash; a null hash equals only another null."""
    a, b = now.select(key, F.col(hash_column).alias("h1"), F.lit(True).alias("n")), before.select(key, F.col(hash_column).alias("h2"), F.lit(True).alias("o"))
    rows = a.join(b, key, "full")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "gone").when(~F.col("h1").eqNullSafe(F.col("h2")), "changed")
    return rows.select(key, kind.alias("change")).filter("change is not null")


def surely_unchanged(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rel) whose size and time are known and equal; unknown (null or 0) never counts as equal."""
    known = "size > 0 and mtime > 0"
    return now.filter(known).join(before.filter(known).select("rel", "size", "mtime"), ["rel", "size", "mtime"], "left_semi").select("rel").distinct()


def refreshed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rel, size, mtime) of files of the same known content whose known size or time is not what was stored."""
    was = before.filter("content_hash is not null").select("rel", "content_hash", F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    rows = now.filter("size > 0 and mtime > 0").join(was, ["rel", "content_hash"])
    return rows.filter(~(F.col("size").eqNullSafe(F.col("_s")) & F.col("mtime").eqNullSafe(F.col("_m")))).select("rel", "size", "mtime")


def served(files: DataFrame, cache: DataFrame, rules: list[str], config: str) -> DataFrame:
    """(rel) of files whose cached results may be used: same content and configuration, every rule present."""
    hits = cache.filter((F.col("config_hash") == config) & F.col("rule").isin(*rules)).select("rel", "content_hash", "rule").distinct()
    full = hits.groupBy("rel", "content_hash").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(rules)))
    return files.select("rel", "content_hash").join(full, ["rel", "content_hash"], "left_semi").select("rel").distinct()


def uncovered(events: DataFrame, covers: DataFrame, key: str, order: str) -> DataFrame:
    """Events with no earlier cover of the same key: one minimum per key instead of a range join."""
    first = covers.groupBy(key).agg(F.min(order).alias("_first"))
    rows = events.join(first, key, "left")
    return rows.filter(F.col("_first").isNull() | (F.col("_first") >= F.col(order))).drop("_first")


def first_created_unlocked(created: DataFrame, locked: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """(key, payload) at the first creation of each key that was never locked."""
    first = created.groupBy(key).agg(F.min_by(payload, F.struct(*order)).alias(payload))
    return first.join(locked.select(key).distinct(), key, "left_anti")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A new set of rows per key takes the place of the old one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
