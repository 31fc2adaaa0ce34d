"""Findings to one verdict: suppression, overrides, baseline, total order, counts and cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalar import CONFIDENCES, SEVERITIES, finding_id, rank, trimmed
from gritstone.session import checkpointed, shuffle_partitions


def one_per_id(findings: DataFrame) -> DataFrame:
    """Doubled rows count once; rows without an id are left out."""
    return findings.filter("id is not null").dropDuplicates(["id"])


def total_order() -> list[Column]:
    """Confidence, severity, rule, file, line, column, id: no two findings tie."""
    return [rank(F.col("confidence"), CONFIDENCES), rank(F.col("severity"), SEVERITIES), F.col("rule"), F.col("file"), F.col("span.start_line"), F.col("span.start_col"), F.col("id")]


def counts(findings: DataFrame, *by: str) -> DataFrame:
    """Findings per severity, blocking ones (confidence high) and the status they give; no finding passes."""
    sums = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    blocking = F.count_if(F.col("confidence") == "high")
    status = F.when(blocking > 0, "block").when(F.count("*") > 0, "advisory").otherwise("pass")
    return findings.groupBy(*by).agg(*sums, blocking.alias("blocking"), status.alias("status"))


def top(findings: DataFrame, cap: int = 10) -> DataFrame:
    """The first findings in total order with the number left out; the cap is the report's feature."""
    total = findings.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("truncated"))
    return findings.orderBy(*total_order()).limit(cap).join(F.broadcast(total))


def without_baseline(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose id nobody accepted; severity is not compared."""
    return findings.join(accepted.select("id").distinct(), "id", "left_anti")


def without_allowed(findings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Findings on no allowed line (rel, line)."""
    on = (F.col("file") == F.col("rel")) & (F.col("span.start_line") == F.col("line"))
    return findings.join(allowed.select("rel", "line").distinct(), on, "left_anti")


def overridden(findings: DataFrame, severities: dict[str, str], locked: dict[str, str] | None = None) -> DataFrame:
    """Severities per rule from a configuration; locked rules have the severity named with them, whatever is stored."""
    new = F.col("severity")
    for rule, severity in {**severities, **(locked or {})}.items():
        new = F.when(F.col("rule") == rule, severity).otherwise(new)
    return findings.withColumn("severity", new)


def ranked(findings: DataFrame, within: str) -> DataFrame:
    """``findings`` with their place, from 1, in the total order of each value of ``within``.

    Rows are cut into ranges of (value, order), so a value with a third of all rows
    is many tasks. A task numbers its own rows; what comes before them is a sum over
    one row per range and value.
    """
    order = total_order()
    keys = [f"_o{k}" for k in range(len(order))]
    rows = findings.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    cut = rows.repartitionByRange(shuffle_partitions(findings.sparkSession), within, *keys).withColumn("_part", F.spark_partition_id())
    cut = checkpointed(cut)
    own = F.row_number().over(Window.partitionBy("_part", within).orderBy(*keys))
    sizes = cut.groupBy(within, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col(within).alias("_w"), F.col("_part").alias("_p"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    out = cut.withColumn("_own", own).join(before, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("place", (F.col("_own") + F.col("_before")).cast("long")).drop(*keys, "_part", "_own", "_w", "_p", "_before")


def assembled(stored: DataFrame, fresh: DataFrame, graph: DataFrame, unchanged: DataFrame) -> DataFrame:
    """(id, rule, rel, origin): stored findings of ``unchanged`` files (rel), fresh ones of all others, and all of the graph.

    Findings are (id, rule, rel). An id that comes from several sources counts once,
    the stored one first. Rows without an id are left out.
    """
    same = unchanged.select("rel").distinct()
    parts = [
        stored.join(same, "rel", "left_semi").select("id", "rule", "rel", F.lit("stored").alias("origin"), F.lit(1).alias("_o")),
        fresh.join(same, "rel", "left_anti").select("id", "rule", "rel", F.lit("fresh").alias("origin"), F.lit(2).alias("_o")),
        graph.select("id", "rule", "rel", F.lit("graph").alias("origin"), F.lit(3).alias("_o")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2]).filter("id is not null")
    first = rows.groupBy("id").agg(F.min(F.struct("_o", "rule", "rel", "origin")).alias("v"))
    return first.select("id", "v.rule", "v.rel", "v.origin")


def in_scope(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Findings of files in ``scope`` (rel)."""
    return findings.join(scope.select(F.col("rel").alias("file")).distinct(), "file", "left_semi")


def with_ordinals(rows: DataFrame, *within: str) -> DataFrame:
    """The number of identical earlier lines within the columns, from 0; over all lines, before any filter."""
    w = Window.partitionBy(*within, trimmed(F.col("text"))).orderBy("line")
    return rows.withColumn("ordinal", F.row_number().over(w) - 1)


def identified(rows: DataFrame, rule: str) -> DataFrame:
    """Ids that survive moved lines: from the trimmed line and its ordinal."""
    anchor = F.concat_ws("\x1f", trimmed(F.col("text")), F.col("ordinal").cast("string"))
    return rows.withColumn("id", finding_id(F.lit(rule), F.col("rel"), anchor))


# The level of each severity in the exchange format.
LEVELS = {"high": "error", "medium": "warning", "low": "note"}


def sarif_results(findings: DataFrame) -> DataFrame:
    """(id, result): one JSON result each; columns count from 1 there."""
    level = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in LEVELS.items()], F.lit("none"))
    region = F.struct(
        F.col("span.start_line").alias("startLine"), (F.col("span.start_col") + 1).alias("startColumn"), F.col("span.end_line").alias("endLine"), (F.col("span.end_col") + 1).alias("endColumn")
    )
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.col("evidence").alias("message"), F.col("file").alias("uri"), region.alias("region"), F.col("id").alias("fingerprint"))
    return findings.select("id", F.to_json(result).alias("result"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    """(id, row): a table row each, with cell separators and backticks escaped and line ends folded."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"([|`])", r"\\$1"), r"\s+", " ")
    where = F.concat_ws(":", cell("file"), F.col("span.start_line").cast("string"))
    return findings.select("id", F.concat(F.lit("| "), F.concat_ws(" | ", "severity", cell("rule"), where, cell("evidence")), F.lit(" |")).alias("row"))
