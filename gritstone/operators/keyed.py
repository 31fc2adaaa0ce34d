"""Joins with a table of one row per key, safe for keys that hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gritstone.session import shuffle_partitions

HOT_ROWS = 1000  # a key of fewer rows is never hot


def answered_by(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``rows``, kept as they are, with the columns of ``answers`` (one row per key); without an answer these are null.

    Keys, null among them, above a share of all rows are spread over salts, and only
    their answers are repeated. There are fewer such keys than four times the
    shuffle partitions, so they may pass through the driver. ``rows`` are read
    twice, so they should be checkpointed or a table.
    """
    spark, width = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    least = max(HOT_ROWS, rows.count() // (4 * width))
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    found = counts.filter(F.col("_n") > least).select(key).collect()
    if not found:
        return rows.join(answers, key, "left")
    schema = StructType([StructField(key, rows.schema[key].dataType), StructField("_salts", IntegerType())])
    hot = F.broadcast(spark.createDataFrame([(r[0], width) for r in found], schema))
    salts = F.when(F.col(key).isNull(), F.lit(width)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    copies = answers.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
