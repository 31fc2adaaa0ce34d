"""Queries over stored findings: suppression, baseline, order, counts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions.scalar import finding_id, trimmed
from gritstone.operators import verdict as V
from gritstone.session import table

OVERRIDES = {"dead-export": "high", "leftover-debug": "low", "secret-exposed": "low"}
LOCKED = {"secret-exposed": "high"}  # rules no configuration may change, with their own severity
ALLOW_MARK = "note:"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.one_per_id(table(spark, sf_dir, "findings"))


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts(_findings(spark, sf_dir))


def verdict_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts(_findings(spark, sf_dir), "rule")


def verdict_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts(_findings(spark, sf_dir).withColumn("repo", F.substring_index("file", "/", 1)), "repo")


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top(_findings(spark, sf_dir)).select("id", "rule", "severity", "confidence", "truncated")


def finding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each finding in the total order of its repository."""
    rows = _findings(spark, sf_dir).withColumn("repo", F.substring_index("file", "/", 1))
    return V.ranked(rows, "repo").select("id", "repo", "place")


def baseline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work markers of the present texts whose finding nobody knows yet: fresh ids against those of the stored findings."""
    from gritstone.plans.text import agent_markers

    rows = table(spark, sf_dir, "findings").filter("id is not null and file is not null and evidence is not null")
    anchor = F.concat_ws("\x1f", trimmed(F.col("evidence")), F.lit("0"))
    known = rows.select(finding_id(F.lit("leftover-agent-marker"), F.col("file"), anchor).alias("id"))
    return V.without_baseline(agent_markers(spark, sf_dir), known).select("rel", "line", "id")


def allow_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.plans.text import source_lines

    allowed = source_lines(spark, sf_dir).filter(F.col("text").contains(ALLOW_MARK))
    return V.without_allowed(_findings(spark, sf_dir), allowed).select("id", "file")


def severity_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.counts(V.overridden(_findings(spark, sf_dir), OVERRIDES, LOCKED), "rule")


def scoped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = table(spark, sf_dir, "parsed_files").filter("has_error")
    return V.in_scope(_findings(spark, sf_dir), broken).select("id", "file")


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _findings(spark, sf_dir)
    return rows.select("id", finding_id(F.col("rule"), F.col("file"), F.coalesce("evidence", F.lit(""))).alias("own_id"))


def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.sarif_results(_findings(spark, sf_dir))


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.markdown_rows(_findings(spark, sf_dir))


def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each file is named as related to a finding elsewhere."""
    rows = _findings(spark, sf_dir).select("id", F.explode("related").alias("rel")).distinct()
    return rows.groupBy("rel").agg(F.count("*").alias("findings"))


def weakness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per class of weakness, with one row for all."""
    rows = _findings(spark, sf_dir)
    grouped = rows.rollup("owasp", "cwe").agg(F.count("*").alias("findings"), F.grouping_id().alias("level"))
    return grouped.select("owasp", "cwe", F.col("level").cast("long"), "findings")


QUERIES = {
    f.__name__: f
    for f in (verdict, verdict_by_rule, verdict_by_repo, top_findings, finding_rank, baseline_filter, allow_suppression, severity_overrides, scoped_findings, finding_ids, sarif_report, markdown_report, related_files, weakness_counts)
}

_ONE = "f AS (SELECT DISTINCT id, rule, severity, confidence, file, span, evidence, owasp, cwe FROM findings WHERE id IS NOT NULL)"
_COUNTS = """count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
 count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE confidence = 'high') AS blocking,
 CASE WHEN count(*) FILTER (WHERE confidence = 'high') > 0 THEN 'block' WHEN count(*) > 0 THEN 'advisory' ELSE 'pass' END AS status"""
_CONF = "CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
_SEV = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_ORDER = f"{_CONF}, {_SEV}, rule NULLS FIRST, file NULLS FIRST, span.start_line NULLS FIRST, span.start_col NULLS FIRST, id"
_LINES = r"""lines AS (SELECT rel, i AS line, parts[i] AS text FROM (SELECT rel, string_split_regex(regexp_replace(source, '\r?\n$', ''), '\r?\n') AS parts
 FROM (SELECT DISTINCT rel, source FROM parsed_files WHERE rel IS NOT NULL AND source IS NOT NULL)) p, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""

_TEXT = "'\"{0}\":' || CAST(to_json({1}) AS VARCHAR)"
_NUMBER = "'\"{0}\":' || CAST({1} AS VARCHAR)"
_REGION = ", ".join(_NUMBER.format(*x) for x in (("startLine", "span.start_line"), ("startColumn", "span.start_col + 1"), ("endLine", "span.end_line"), ("endColumn", "span.end_col + 1")))
_LEVEL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'none' END"
_FIELDS = f"""{_TEXT.format('ruleId', 'rule')}, {_TEXT.format('level', _LEVEL)}, {_TEXT.format('message', 'evidence')}, {_TEXT.format('uri', 'file')}, '"region":{{' || array_to_string(list_filter([{_REGION}], lambda y: y IS NOT NULL), ',') || '}}', {_TEXT.format('fingerprint', 'id')}"""

_MARKED = r"regexp_matches(text, '^\s*(?://|#|/\*|\*)') AND regexp_matches(text, '\b(?:TODO|FIXME|HACK|XXX)\b') AND NOT regexp_matches(text, 'https?://|#[0-9]+|\b[A-Z]{2,}-[0-9]+\b')"

ORACLE_SQL = {
    "verdict": f"WITH {_ONE} SELECT {_COUNTS} FROM f",
    "verdict_by_rule": f"WITH {_ONE} SELECT rule, {_COUNTS} FROM f GROUP BY rule",
    "verdict_by_repo": f"WITH {_ONE} SELECT split_part(file, '/', 1) AS repo, {_COUNTS} FROM f GROUP BY 1",
    "top_findings": f"WITH {_ONE} SELECT id, rule, severity, confidence, (SELECT greatest(count(*) - 10, 0) FROM f) AS truncated FROM f ORDER BY {_ORDER} LIMIT 10",
    "finding_rank": f"WITH {_ONE} SELECT id, split_part(file, '/', 1) AS repo, row_number() OVER (PARTITION BY split_part(file, '/', 1) ORDER BY {_ORDER}) AS place FROM f",
    "baseline_filter": rf"WITH {_LINES}, o AS (SELECT rel, line, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY rel, regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY line) - 1 AS n FROM lines), m AS (SELECT rel, line, substr(sha256(concat_ws(chr(31), 'leftover-agent-marker', rel, concat_ws(chr(31), t, CAST(n AS VARCHAR)))), 1, 16) AS id FROM o WHERE {_MARKED}), b AS (SELECT substr(sha256(concat_ws(chr(31), 'leftover-agent-marker', file, concat_ws(chr(31), regexp_replace(evidence, '^\s+|\s+$', '', 'g'), '0'))), 1, 16) AS id FROM findings WHERE id IS NOT NULL AND file IS NOT NULL AND evidence IS NOT NULL) SELECT rel, line, id FROM m WHERE id NOT IN (SELECT id FROM b)",
    "allow_suppression": f"WITH {_ONE}, {_LINES}, a AS (SELECT DISTINCT rel, line FROM lines WHERE contains(text, '{ALLOW_MARK}')) SELECT id, file FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.rel = f.file AND a.line = f.span.start_line)",
    "severity_overrides": f"WITH g AS (SELECT DISTINCT id, rule, severity, confidence FROM findings WHERE id IS NOT NULL), f AS (SELECT id, rule, confidence, CASE rule WHEN 'secret-exposed' THEN 'high' WHEN 'dead-export' THEN 'high' WHEN 'leftover-debug' THEN 'low' ELSE severity END AS severity FROM g) SELECT rule, {_COUNTS} FROM f GROUP BY rule",
    "scoped_findings": f"WITH {_ONE} SELECT id, file FROM f WHERE file IN (SELECT rel FROM parsed_files WHERE has_error)",
    "finding_ids": rf"WITH {_ONE} SELECT id, substr(sha256(concat_ws(chr(31), rule, file, regexp_replace(coalesce(evidence, ''), '^\s+|\s+$', '', 'g'))), 1, 16) AS own_id FROM f",
    "sarif_report": f"WITH {_ONE} SELECT id, '{{' || array_to_string(list_filter([{_FIELDS}], lambda x: x IS NOT NULL), ',') || '}}' AS result FROM f",
    "markdown_report": r"WITH f AS (SELECT DISTINCT id, rule, severity, file, span, evidence FROM findings WHERE id IS NOT NULL) SELECT id, concat('| ', concat_ws(' | ', severity, regexp_replace(regexp_replace(coalesce(rule, ''), '([|`])', '\\\1', 'g'), '\s+', ' ', 'g'), concat_ws(':', regexp_replace(regexp_replace(coalesce(file, ''), '([|`])', '\\\1', 'g'), '\s+', ' ', 'g'), CAST(span.start_line AS VARCHAR)), regexp_replace(regexp_replace(coalesce(evidence, ''), '([|`])', '\\\1', 'g'), '\s+', ' ', 'g')), ' |') AS row FROM f",
    "related_files": "SELECT rel, count(*) AS findings FROM (SELECT DISTINCT id, unnest(related) AS rel FROM findings WHERE id IS NOT NULL) GROUP BY rel",
    "weakness_counts": "WITH f AS (SELECT DISTINCT id, owasp, cwe FROM findings WHERE id IS NOT NULL) SELECT owasp, cwe, CAST(GROUPING(owasp, cwe) AS BIGINT) AS level, count(*) AS findings FROM f GROUP BY ROLLUP (owasp, cwe)",
}
