"""Queries over the import graph and over ordered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import imports as I
from gritstone.operators import sequences as Q
from gritstone.plans.resolution import candidates_sql, modules_sql, resolver_sql
from gritstone.session import table
from gritstone.sources import manifests

ENTRIES = ["app/**", "**/app/**", "index.*", "**/index.*", "**/*.test.*", "**/tests/**", "**/*.config.*", "**/scripts/**", "**/bin/**"]
BOUNDARIES = [("server-from-lib", "*/lib/**", ["*/server/**"], []), ("vendor-from-src", "*/src/**", ["*/vendor/**", "*/src/vendor/**"], []), ("scripts-alone", "*/scripts/**", [], ["*/lib/**", "*/src/**"])]
RULES = ["leftover-debug"]
CAP = 3
SINCE = "2024-01-03"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.one_per_edge(table(spark, sf_dir, "edges"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.current_files(table(spark, sf_dir, "files"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def current_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("rel", "indexed_at", "content_hash")


def dead_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.dead_files(_files(spark, sf_dir), _edges(spark, sf_dir), ENTRIES)


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written for every repository: it starts from its index, its first script and its first server file."""
    rels = _files(spark, sf_dir).select("rel", F.substring_index("rel", "/", 1).alias("top"))
    inside = lambda folder: F.min(F.when(F.col("rel").rlike(rf"^[^/]+/{folder}/.*\.(?:[mc]?[jt]s)$"), F.regexp_replace("rel", "^[^/]+/", "")))
    tops = rels.groupBy("top").agg(F.coalesce(inside("scripts"), F.lit("none.js")).alias("script"), F.coalesce(inside("server"), F.lit("none.js")).alias("server"))
    text = F.format_string('{"name": "@x/%s", "main": "./src/index", "bin": {"run": "%s"}, "scripts": {"start": "node --flag ./%s && echo done"}, "workspaces": ["packages/*"]}', "top", "script", "server")
    return manifests.manifests(tops.select(F.concat("top", F.lit("/package.json")).alias("rel"), text.alias("text")))


def dead_file_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead files where manifests name entry points too."""
    files = _files(spark, sf_dir)
    return I.dead_files(files, _edges(spark, sf_dir), ENTRIES[:2], manifests.entry_files(_manifests(spark, sf_dir), files))


def dead_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gritstone.plans.text import exported_names

    return I.dead_exports(exported_names(spark, sf_dir), _edges(spark, sf_dir))


def boundary_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.boundary_violations(_edges(spark, sf_dir), BOUNDARIES)


def edges_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "parsed_files").filter("has_error").select("rel").distinct()
    return I.neighbours(_edges(spark, sf_dir), scope)


def resolve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resolved(_edges(spark, sf_dir), table(spark, sf_dir, "files"))


def departed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after the files that were ever removed are gone."""
    gone = table(spark, sf_dir, "removed_files").select("rel").distinct()
    present = _files(spark, sf_dir).select("rel").join(gone, "rel", "left_anti")
    rows = I.without_departed(_edges(spark, sf_dir), present)
    return rows.groupBy("resolution").agg(F.count("*").alias("edges"), F.count("to_rel").alias("targets"))


def unresolved_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("resolution = 'unresolved'").select("from_rel").distinct()


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importers and imported names per file; the hottest target is partially aggregated like any other."""
    rows = _edges(spark, sf_dir).filter("to_rel is not null")
    return rows.groupBy("to_rel").agg(F.count_distinct("from_rel").alias("importers"), F.count_distinct("name").alias("names"), F.count("*").alias("edges"))


def edge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per kind, one column per resolution."""
    rows = _edges(spark, sf_dir).groupBy("kind").pivot("resolution", ["resolved", "external", "unresolved"]).agg(F.count(F.lit(1)))
    return rows.select("kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("resolved", "external", "unresolved")])


def late_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per month of sight and how many were loaded a week and more later."""
    rows = _edges(spark, sf_dir).filter("seen_at is not null")
    late = F.unix_micros(F.col("loaded_at").cast("timestamp")) - F.unix_micros(F.col("seen_at").cast("timestamp")) >= 7 * 86_400_000_000
    return rows.groupBy(F.date_format("seen_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("edges"), F.count_if(late).alias("late"))


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content differs between mid-year and the last indexing."""
    files = table(spark, sf_dir, "files")
    return Q.changed(I.current_files(files), I.current_files(files.filter("indexed_at < 1751328000")), "rel", "content_hash")


def surely_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    return Q.surely_unchanged(I.current_files(files), I.current_files(files.filter("indexed_at < 1751328000")))


def cache_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose results of mid-year may still be served: of the same content, every rule with a result."""
    files = table(spark, sf_dir, "files")
    found = table(spark, sf_dir, "findings").select(F.col("file").alias("rel"), "rule").distinct()
    cache = found.join(I.current_files(files.filter("indexed_at < 1751328000")).select("rel", "content_hash"), "rel").withColumn("config_hash", F.lit("c1"))
    return Q.served(I.current_files(files), cache, RULES, "c1")


def newly_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that a user has for the first time since SINCE, and whether they had any before."""
    ev = _events(spark, sf_dir).withColumn("user", F.col("user_id"))
    return Q.newly(ev.filter(F.col("ts") >= SINCE), ev.filter(F.col("ts") < SINCE), "user", "event_type")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.runs(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type", 3)


def hook_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.counted_with_reset(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", CAP)
    return rows.select("event_id", F.col("round").cast("long"), "silent")


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def route_without_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    return Q.uncovered(ev.filter("event_type = 'click'"), ev.filter("event_type = 'signup'"), "user_id", "ts").select("event_id", "user_id")


def created_unlocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    locked = lines.filter("l_returnflag = 'R' and l_quantity > 40").select("l_partkey")
    return Q.first_created_unlocked(lines, locked, "l_partkey", ["l_shipdate", "l_orderkey", "l_linenumber"], "l_orderkey")


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of July take the place of all older edges of the same file."""
    rows = _edges(spark, sf_dir).select("edge_id", "from_rel", "seen_at")
    july = F.date_format("seen_at", "yyyy-MM") == "2025-07"
    out = Q.replaced(rows.filter(F.col("seen_at") < "2025-07-01"), rows.filter(july), "from_rel")
    return out.groupBy("from_rel").agg(F.count("*").alias("edges"))


QUERIES = {
    f.__name__: f
    for f in (current_files, dead_file, dead_file_by_manifest, dead_export, boundary_violation, edges_neighbours, resolve_ranked, departed_edges, unresolved_importers, fan_in, edge_kinds, late_edges, changed_files, surely_unchanged, cache_serve, newly_skipped, event_runs, hook_rounds, latest_event, route_without_cover, created_unlocked, replaced_rows)
}

_NORM = "regexp_replace(replace({0}, '\\', '/'), '^\\./', '')"
_E = f"e AS (SELECT edge_id, {_NORM.format('from_rel')} AS from_rel, {_NORM.format('to_rel')} AS to_rel, specifier, name, kind, resolution, line, seen_at, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at, seen_at) AS k FROM edges WHERE edge_id IS NOT NULL) WHERE k = 1)"
_F = "c AS (SELECT rel, indexed_at, content_hash, size, mtime FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY indexed_at DESC NULLS LAST, content_hash DESC NULLS LAST, language DESC NULLS LAST, parse_status DESC NULLS LAST, size DESC NULLS LAST, mtime DESC NULLS LAST) AS k FROM files WHERE rel IS NOT NULL) WHERE k = 1)"
_P = _F.replace("c AS", "p AS", 1).replace("WHERE rel IS NOT NULL", "WHERE rel IS NOT NULL AND indexed_at < 1751328000")
_ENTRY = "^app/.*$|^(?:.*/)?app/.*$|^index\\..*$|^(?:.*/)?index\\..*$|^(?:.*/)?.*\\.test\\..*$|^(?:.*/)?tests/.*$|^(?:.*/)?.*\\.config\\..*$|^(?:.*/)?scripts/.*$|^(?:.*/)?bin/.*$"



def _dead_sql() -> str:
    from gritstone.plans.text import _CLEAN, _EXPORTED

    # Common table expressions of both sides go by names of their own.
    return f"{_CLEAN}, {_EXPORTED}"


ORACLE_SQL = {
    "current_files": f"WITH {_F} SELECT rel, indexed_at, content_hash FROM c",
    "dead_file": f"WITH {_E}, {_F} SELECT rel FROM c WHERE NOT regexp_matches(rel, '{_ENTRY}') AND rel NOT IN (SELECT to_rel FROM e WHERE to_rel IS NOT NULL)",
    "dead_file_by_manifest": rf"WITH {_E}, {_F}, mt AS (SELECT split_part(rel, '/', 1) AS top, min(CASE WHEN regexp_matches(rel, '^[^/]+/scripts/.*\.(?:[mc]?[jt]s)$') THEN rel END) AS a, min(CASE WHEN regexp_matches(rel, '^[^/]+/server/.*\.(?:[mc]?[jt]s)$') THEN rel END) AS b FROM c GROUP BY 1), mw AS (SELECT top || '/src/index' AS wanted FROM mt UNION SELECT a FROM mt WHERE a IS NOT NULL UNION SELECT b FROM mt WHERE b IS NOT NULL), mc AS ({candidates_sql('mw', 'wanted')}), mm AS ({modules_sql()}), mb AS (SELECT arg_min(rel, k) AS rel FROM mc JOIN mm ON mc.path = mm.rel GROUP BY wanted) SELECT rel FROM c WHERE NOT regexp_matches(rel, '^app/.*$|^(?:.*/)?app/.*$') AND rel NOT IN (SELECT to_rel FROM e WHERE to_rel IS NOT NULL) AND rel NOT IN (SELECT rel FROM mb)",
    "dead_export": f"WITH {_E}, {_dead_sql()} SELECT rel, name FROM x WHERE EXISTS (SELECT 1 FROM e WHERE e.to_rel = x.rel) AND NOT EXISTS (SELECT 1 FROM e WHERE e.to_rel = x.rel AND (e.name = x.name OR e.name = '*'))",
    "boundary_violation": f"WITH {_E}, b AS (SELECT from_rel, line, to_rel, CASE WHEN regexp_matches(from_rel, '^.*/lib/.*$') AND regexp_matches(to_rel, '^.*/server/.*$') THEN 'server-from-lib' END AS label FROM e UNION SELECT from_rel, line, to_rel, CASE WHEN regexp_matches(from_rel, '^.*/src/.*$') AND regexp_matches(to_rel, '^.*/vendor/.*$|^.*/src/vendor/.*$') THEN 'vendor-from-src' END FROM e UNION SELECT from_rel, line, to_rel, CASE WHEN regexp_matches(from_rel, '^.*/scripts/.*$') AND NOT regexp_matches(to_rel, '^.*/lib/.*$|^.*/src/.*$|^.*/scripts/.*$') THEN 'scripts-alone' END FROM e) SELECT DISTINCT from_rel, line, to_rel, label FROM b WHERE label IS NOT NULL AND to_rel IS NOT NULL",
    "edges_neighbours": f"WITH {_E}, s AS (SELECT DISTINCT rel FROM parsed_files WHERE has_error AND rel IS NOT NULL), p AS (SELECT DISTINCT from_rel, to_rel FROM e WHERE to_rel IS NOT NULL) SELECT rel FROM s UNION SELECT to_rel FROM p WHERE from_rel IN (SELECT rel FROM s) UNION SELECT from_rel FROM p WHERE to_rel IN (SELECT rel FROM s) AND from_rel IS NOT NULL",
    "resolve_ranked": f"WITH {_E}, {resolver_sql('e')} SELECT edge_id, target FROM resolved",
    "departed_edges": f"WITH {_E}, g AS (SELECT DISTINCT rel FROM files WHERE rel IS NOT NULL AND rel NOT IN (SELECT rel FROM removed_files WHERE rel IS NOT NULL)), k AS (SELECT CASE WHEN to_rel IS NOT NULL AND to_rel NOT IN (SELECT rel FROM g) THEN 'unresolved' ELSE resolution END AS resolution, CASE WHEN to_rel IN (SELECT rel FROM g) THEN to_rel END AS to_rel FROM e WHERE from_rel IN (SELECT rel FROM g)) SELECT resolution, count(*) AS edges, count(to_rel) AS targets FROM k GROUP BY resolution",
    "unresolved_importers": f"WITH {_E} SELECT DISTINCT from_rel FROM e WHERE resolution = 'unresolved'",
    "fan_in": f"WITH {_E} SELECT to_rel, count(DISTINCT from_rel) AS importers, count(DISTINCT name) AS names, count(*) AS edges FROM e WHERE to_rel IS NOT NULL GROUP BY to_rel",
    "edge_kinds": f"WITH {_E} SELECT kind, count(*) FILTER (WHERE resolution = 'resolved') AS resolved, count(*) FILTER (WHERE resolution = 'external') AS external, count(*) FILTER (WHERE resolution = 'unresolved') AS unresolved FROM e GROUP BY kind",
    "late_edges": f"WITH {_E} SELECT strftime(seen_at, '%Y-%m') AS month, count(*) AS edges, count(*) FILTER (WHERE epoch_us(loaded_at) - epoch_us(seen_at) >= 604800000000) AS late FROM e WHERE seen_at IS NOT NULL GROUP BY 1",
    "changed_files": f"WITH {_F}, {_P} SELECT coalesce(c.rel, p.rel) AS rel, CASE WHEN p.rel IS NULL THEN 'added' WHEN c.rel IS NULL THEN 'gone' ELSE 'changed' END AS change FROM c FULL JOIN p ON c.rel = p.rel WHERE p.rel IS NULL OR c.rel IS NULL OR c.content_hash IS DISTINCT FROM p.content_hash",
    "surely_unchanged": f"WITH {_F}, {_P} SELECT c.rel FROM c JOIN p ON c.rel = p.rel AND c.size = p.size AND c.mtime = p.mtime WHERE c.size > 0 AND c.mtime > 0",
    "cache_serve": f"WITH {_F}, {_P}, r AS (SELECT DISTINCT file AS rel FROM findings WHERE rule = 'leftover-debug') SELECT c.rel FROM c JOIN p ON c.rel = p.rel AND c.content_hash = p.content_hash JOIN r ON c.rel = r.rel",
    "newly_skipped": "WITH n AS (SELECT DISTINCT user_id AS user, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03'), o AS (SELECT DISTINCT user_id AS user, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03') SELECT n.user AS user, n.event_type AS event_type, n.user IN (SELECT user FROM o) AS known FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user = n.user AND o.event_type = n.event_type)",
    "event_runs": "WITH i AS (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first, count(*) AS length FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3",
    "hook_rounds": "WITH m AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ep FROM events), n AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ep ORDER BY ts, event_id) AS n FROM m) SELECT event_id, CAST(least(n, 3) AS BIGINT) AS round, bool_or(n > 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS silent FROM n",
    "latest_event": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "route_without_cover": "SELECT event_id, user_id FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts < e.ts)",
    "created_unlocked": "SELECT l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)",
    "replaced_rows": f"WITH {_E}, j AS (SELECT edge_id, from_rel FROM e WHERE strftime(seen_at, '%Y-%m') = '2025-07'), a AS (SELECT edge_id, from_rel FROM e WHERE seen_at < TIMESTAMP '2025-07-01' AND from_rel NOT IN (SELECT from_rel FROM j WHERE from_rel IS NOT NULL) UNION ALL SELECT edge_id, from_rel FROM j) SELECT from_rel, count(*) AS edges FROM a GROUP BY from_rel",
}
