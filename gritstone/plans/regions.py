"""Queries over regions of files, families, samples, tokens in text and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import scalar as S
from gritstone.operators import evaluation, imports, regions, sequences, testcases, verdict
from gritstone.plans.findings import _LINES
from gritstone.plans.graph import _E, _F, _P, dead_export
from gritstone.plans.resolution import candidates_sql, modules_sql
from gritstone.plans.similarity import _pairs
from gritstone.plans.text import agent_markers, language, source_lines
from gritstone.session import table

ALIASES = [("@umbra/*", ["umbra-*/src", "umbra-mono/packages/*"]), ("@umbra/kit", ["umbra-kit/lib", "umbra-kit/src"]), ("@*", ["packages/*"])]
CHECKED = ["secret-exposed", "dead-export", "leftover-debug"]
BEFORE = 1751328000
QUOTA = 20
LEAST = 5  # findings of a rule before its share is given
ENDS = r"^\s*(?:return\b.*;|throw\b.*;|break;|continue;|return\b[^({\[]*|raise\b.*|break|continue)\s*$"
EXEMPT = r"^\s*(?:[})\]]|case\b|default\b|else\b|elif\b|except\b|finally\b|//|#|/\*|\*|<\?|\?>)"
PLANT = r"(?m)^([ \t]+)(return [\w.]+;|throw .*;|break;|continue;)$"
TOKEN = r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,})"
ADDRESS = r"\b([a-z][a-z0-9+.-]*)://([^\s:/@'\"]+):([^\s@'\"]+)@([A-Za-z0-9.-]+)"

# Passwords of development setups, and hosts of one's own machine.
DEVELOPMENT = ("password", "postgres", "root", "admin", "secret", "test", "guest", "user", "mysql", "redis", "dev", "local")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0", "::1", "host.docker.internal", "db")


def finding_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, owner): the narrowest function around the start of each finding."""
    found = table(spark, sf_dir, "findings").select(F.col("file").alias("rel"), F.col("span.start_line").alias("line"), F.col("id").alias("point"))
    held = table(spark, sf_dir, "function_records").select(F.col("file").alias("rel"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("region"))
    return regions.enclosing(found, held).select(F.col("point").alias("id"), F.col("region").alias("owner"))


def line_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, owner, lines) of the lines that belong to each function and to no narrower one."""
    lines = source_lines(spark, sf_dir).select("rel", "line", F.struct("rel", "line").alias("point"))
    held = table(spark, sf_dir, "function_records").select(F.col("file").alias("rel"), F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("id").alias("region"))
    rows = regions.enclosing(lines, held)
    return rows.groupBy(F.col("point.rel").alias("rel"), F.col("region").alias("owner")).agg(F.count("*").alias("lines"))


def related_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files tied by findings that name them together; index files stand for their family first."""
    links = table(spark, sf_dir, "findings").select(F.col("file").alias("a"), F.explode("related").alias("b"))
    return regions.families(links, F.col("name").rlike(r"(^|/)index\.")).select(F.col("name").alias("rel"), "family")


def _written_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, source): a test file written for every file with functions, one case a function.

    Every fifth case is skipped and a case asserts as often as its function has
    parameters, so what is read back can be told from the functions.
    """
    rows = table(spark, sf_dir, "function_records").filter("id is not null and file is not null and name is not null").select("id", "file", "name", "start_line", "param_count").distinct()
    skip = F.when(F.col("start_line") % 5 == 0, ".skip").when(F.col("start_line") % 5 == 1, ".only").otherwise("")
    body = F.repeat(F.lit("  expect(made).toBe(1);\n"), F.coalesce("param_count", F.lit(0)))
    case = F.concat(F.lit("it"), skip, F.lit("('"), F.col("name"), F.lit("', () => {\n  const made = run();\n"), body, F.lit("});\n"))
    # One case a function of the file.
    files = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", case.alias("case")))).alias("cases"))
    return files.select(F.concat(F.regexp_replace("file", r"\.[^./]*$", ""), F.lit(".test.ts")).alias("rel"), F.concat(F.lit("import { run } from './run';\n"), F.array_join(F.transform("cases", lambda c: c["case"]), "")).alias("source"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of written test files, read back: how many of each name, skipped or not, and their assertions."""
    found = testcases.cases(_written_tests(spark, sf_dir).filter(testcases.is_test_file(F.col("rel"))))
    return found.groupBy("rel", "name", "skipped").agg(F.count("*").alias("cases"), F.sum("assertions").alias("assertions"))


def asserting_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the written test files that run and assert nothing."""
    found = testcases.without_assertion(testcases.cases(_written_tests(spark, sf_dir)))
    return found.groupBy("rel").agg(F.count("*").alias("cases"))


def assembled_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list from three sources: stored findings of unchanged files, fresh ones of the others, and those of the graph."""
    files = table(spark, sf_dir, "files")
    gone = sequences.changed(imports.current_files(files), imports.current_files(files.filter(F.col("indexed_at") < BEFORE)), "rel", "content_hash").select("rel")
    unchanged = imports.current_files(files).select("rel").join(gone, "rel", "left_anti")
    stored = table(spark, sf_dir, "findings").select("id", "rule", F.col("file").alias("rel"))
    fresh = agent_markers(spark, sf_dir).select("id", F.lit("leftover-agent-marker").alias("rule"), "rel")
    dead = dead_export(spark, sf_dir)
    graph = dead.select(S.finding_id(F.lit("dead-export"), F.col("rel"), F.col("name")).alias("id"), F.lit("dead-export").alias("rule"), "rel")
    return verdict.assembled(stored, fresh, graph, unchanged).select("id", "rule", "rel", "origin")


def label_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to be labelled, so many of each bucket."""
    rows = _pairs(spark, sf_dir).withColumn("bucket", evaluation.bucket())
    return regions.sampled(rows, F.col("bucket"), F.col("pair"), QUOTA).select("pair", "bucket")


def unreachable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that follow the end of their block's flow: in the present files, and in functions with a statement planted there.

    The second half tells whether the rule finds what it should: behind the first
    line of each function that ends its flow a line of the same indentation is put.
    """
    planted = F.regexp_replace("source", PLANT, "$1$2\n$1plantedCall(1);")
    functions = table(spark, sf_dir, "function_records").filter("id is not null and source is not null").select(F.col("id").alias("rel"), planted.alias("source")).distinct()
    lines = functions.select("rel", F.posexplode(S.lines(F.col("source"))).alias("pos", "text")).select("rel", (F.col("pos") + 1).cast("long").alias("line"), "text")
    return regions.after_end(source_lines(spark, sf_dir).distinct().union(lines), ENDS, EXEMPT)


def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = imports.one_per_edge(table(spark, sf_dir, "edges"))
    return imports.resolved_by_alias(edges, table(spark, sf_dir, "files").filter("rel is not null"), ALIASES)


def workspace_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into packages of the workspace: each repository is one, named in its owner's scope, with its sources in src."""
    edges = imports.one_per_edge(table(spark, sf_dir, "edges"))
    packages = table(spark, sf_dir, "repos").select(F.regexp_replace("repo", "^([^-]+)-", "@$1/").alias("name"), F.concat("repo", F.lit("/src")).alias("dir"), F.lit(None).cast("string").alias("main"))
    return imports.resolved_by_package(edges, table(spark, sf_dir, "files").filter("rel is not null"), packages)


def token_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, role, expires) of the signed web tokens in the text, each of several on a line; the token itself is not given."""
    rows = source_lines(spark, sf_dir).select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 1)).alias("token")).distinct()
    body = rows.withColumn("body", S.token_payload(F.col("token")))
    return body.select("rel", "line", F.get_json_object("body", "$.role").alias("role"), F.get_json_object("body", "$.exp").cast("long").alias("expires"))


def address_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, scheme, weak) of addresses with a password, each of several on a line; weak are those of development, which no rule reports."""
    rows = source_lines(spark, sf_dir).select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(ADDRESS), 0)).alias("address")).distinct()
    scheme, user, word, host = (F.regexp_extract("address", ADDRESS, k) for k in (1, 2, 3, 4))
    weak = host.isin(*LOCAL_HOSTS) | (F.lower(user) == F.lower(word)) | F.lower(word).isin(*DEVELOPMENT)
    return rows.select("rel", "line", scheme.alias("scheme"), weak.alias("weak"))


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of sure findings per rule and per rule and language; null below LEAST findings."""
    rows = table(spark, sf_dir, "findings").filter("id is not null").select("id", "rule", "confidence", language(F.col("file")).alias("language")).distinct()
    sums = rows.groupingSets([["rule"], ["rule", "language"]], "rule", "language").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("sure"), F.grouping("language").cast("long").alias("whole"))
    return sums.select("rule", "language", "whole", "n", F.when(F.col("n") >= LEAST, F.round(F.col("sure") / F.col("n"), 6)).alias("share"))


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every present file and checked rule with its number of findings; clean ones have a row too."""
    files = imports.current_files(table(spark, sf_dir, "files")).select("rel", "content_hash", F.explode(F.array(*map(F.lit, CHECKED))).alias("rule"))
    found = table(spark, sf_dir, "findings").filter(F.col("rule").isin(*CHECKED)).select(F.col("file").alias("rel"), "rule", "id").distinct()
    counts = found.groupBy("rel", "rule").agg(F.count("id").alias("n"))
    return files.join(counts, ["rel", "rule"], "left").select("rel", "rule", "content_hash", F.coalesce("n", F.lit(0)).alias("findings"))


def changed_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check of changes reports on: changed, added and departed files and what is one import away."""
    files = table(spark, sf_dir, "files")
    moved = sequences.changed(imports.current_files(files), imports.current_files(files.filter(F.col("indexed_at") < BEFORE)), "rel", "content_hash")
    return imports.neighbours(imports.one_per_edge(table(spark, sf_dir, "edges")), moved.select("rel"))


QUERIES = {
    f.__name__: f
    for f in (finding_owner, line_owners, related_families, label_sample, test_cases, asserting_nothing, assembled_findings, unreachable_lines, alias_targets, workspace_targets, token_roles, address_strength, rule_scores, cache_rows, changed_scope)
}

_NARROW = "row_number() OVER (PARTITION BY {0} ORDER BY f.end_line - f.start_line, f.start_line DESC, f.id)"
_FN = "f AS (SELECT DISTINCT id, file, start_line, end_line FROM function_records WHERE id IS NOT NULL)"
_A = ADDRESS.replace("'", "''")
_PAIRS = "p AS (SELECT concat_ws('|', least(a_id, b_id), greatest(a_id, b_id)) AS pair, bool_or(structural_match) AS sm, max(jaccard) AS j FROM candidate_pairs WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND a_id <> b_id GROUP BY 1)"

_TESTS = r"t AS (SELECT regexp_replace(file, '\.[^./]*$', '') || '.test.ts' AS rel, name, start_line % 5 = 0 AS skipped, coalesce(param_count, 0) AS n FROM (SELECT DISTINCT id, file, name, start_line, param_count FROM function_records WHERE id IS NOT NULL AND file IS NOT NULL AND name IS NOT NULL))"

ORACLE_SQL = {
    "finding_owner": f"WITH {_FN}, g AS (SELECT DISTINCT id, file, span.start_line AS line FROM findings WHERE id IS NOT NULL), o AS (SELECT g.id, f.id AS owner, {_NARROW.format('g.id')} AS k FROM g JOIN f ON f.file = g.file AND g.line BETWEEN f.start_line AND f.end_line) SELECT id, owner FROM o WHERE k = 1",
    "line_owners": f"WITH {_LINES}, {_FN}, o AS (SELECT rel, line, f.id AS owner, {_NARROW.format('rel, line')} AS k FROM lines JOIN f ON f.file = rel AND line BETWEEN f.start_line AND f.end_line) SELECT rel, owner, count(*) AS lines FROM o WHERE k = 1 GROUP BY rel, owner",
    "related_families": r"WITH RECURSIVE x AS (SELECT DISTINCT file AS a, unnest(related) AS b FROM findings WHERE file IS NOT NULL), l AS (SELECT a, b FROM x WHERE a <> b UNION SELECT b, a FROM x WHERE a <> b), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS rel, substr(min(CASE WHEN regexp_matches(b, '(^|/)index\.') THEN '0' ELSE '1' END || b), 2) AS family FROM r GROUP BY a",
    "test_cases": f"WITH {_TESTS} SELECT rel, name, skipped, count(*) AS cases, CAST(sum(n) AS BIGINT) AS assertions FROM t GROUP BY rel, name, skipped",
    "asserting_nothing": f"WITH {_TESTS} SELECT rel, count(*) AS cases FROM t WHERE NOT skipped AND n = 0 GROUP BY rel",
    "label_sample": f"WITH {_PAIRS}, b AS (SELECT pair, CASE WHEN sm THEN 'structural' WHEN j >= 0.6 THEN 'high' WHEN j >= 0.3 THEN 'low' ELSE 'below' END AS bucket FROM p) SELECT pair, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256(pair)) AS k FROM b) WHERE k <= {QUOTA}",
    "unreachable_lines": rf"WITH {_LINES}, pf AS (SELECT DISTINCT id AS rel, regexp_replace(source, '{PLANT}', '\1\2' || chr(10) || '\1plantedCall(1);', 'g') AS source FROM function_records WHERE id IS NOT NULL AND source IS NOT NULL), pl AS (SELECT rel, i AS line, parts[i] AS text FROM (SELECT rel, string_split_regex(regexp_replace(source, '\r?\n$', ''), '\r?\n') AS parts FROM pf) p, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i)), al AS (SELECT DISTINCT rel, line, text FROM lines UNION ALL SELECT rel, line, text FROM pl), n AS (SELECT rel, line, text, lag(text) OVER (PARTITION BY rel ORDER BY line) AS before FROM al WHERE regexp_matches(text, '\S')) SELECT rel, line FROM n WHERE regexp_matches(before, '{ENDS}') AND NOT regexp_matches(text, '{EXEMPT}') AND regexp_extract(before, '^(\s*)', 1) = regexp_extract(text, '^(\s*)', 1)",
    "alias_targets": f"WITH {_E}, t AS (SELECT edge_id, substr(specifier, 9) AS s, specifier FROM e WHERE NOT regexp_matches(specifier, '^[./]')), aw AS (SELECT edge_id, 0 AS pos, 'umbra-kit/lib' AS wanted FROM t WHERE specifier = '@umbra/kit' UNION ALL SELECT edge_id, 1, 'umbra-kit/src' FROM t WHERE specifier = '@umbra/kit' UNION ALL SELECT edge_id, 2, 'umbra-' || substr(specifier, 8) || '/src' FROM t WHERE starts_with(specifier, '@umbra/') UNION ALL SELECT edge_id, 3, 'umbra-mono/packages/' || substr(specifier, 8) FROM t WHERE starts_with(specifier, '@umbra/') UNION ALL SELECT edge_id, 4, 'packages/' || substr(specifier, 2) FROM t WHERE starts_with(specifier, '@')), ac AS ({candidates_sql('aw', 'edge_id, pos')}), am AS ({modules_sql()}), ab AS (SELECT edge_id, arg_min(rel, pos * 100 + k) AS target FROM ac JOIN am ON ac.path = am.rel GROUP BY edge_id) SELECT DISTINCT aw.edge_id AS edge_id, ab.target AS target FROM aw LEFT JOIN ab ON aw.edge_id = ab.edge_id",
    "workspace_targets": rf"WITH {_E}, k AS (SELECT DISTINCT regexp_replace(repo, '^([^-]+)-', '@\1/') AS name, repo || '/src' AS dir FROM repos WHERE repo IS NOT NULL), pw AS (SELECT edge_id, CASE WHEN specifier = k.name THEN dir || '/index' ELSE dir || substr(specifier, length(k.name) + 1) END AS wanted FROM e JOIN k ON specifier = k.name OR starts_with(specifier, k.name || '/')), pc AS ({candidates_sql('pw', 'edge_id')}), pm AS ({modules_sql()}), pb AS (SELECT edge_id, arg_min(rel, k) AS target FROM pc JOIN pm ON pc.path = pm.rel GROUP BY edge_id) SELECT pw.edge_id AS edge_id, pb.target AS target FROM pw LEFT JOIN pb ON pw.edge_id = pb.edge_id",
    "token_roles": rf"WITH {_LINES}, u AS (SELECT DISTINCT rel, line, unnest(regexp_extract_all(text, '{TOKEN}', 1)) AS token FROM lines), t AS (SELECT rel, line, translate(split_part(token, '.', 2), '-_', '+/') AS p FROM u), d AS (SELECT rel, line, try(decode(from_base64(p || repeat('=', CAST((4 - length(p) % 4) % 4 AS INT))))) AS body FROM t) SELECT rel, line, json_extract_string(body, '$.role') AS role, CAST(json_extract_string(body, '$.exp') AS BIGINT) AS expires FROM d",
    "address_strength": rf"WITH {_LINES}, m AS (SELECT DISTINCT rel, line, unnest(regexp_extract_all(text, '{_A}', 0)) AS address FROM lines), a AS (SELECT rel, line, regexp_extract(address, '{_A}', ['scheme', 'u', 'w', 'h']) AS x FROM m) SELECT rel, line, x.scheme AS scheme, x.h IN {LOCAL_HOSTS} OR lower(x.u) = lower(x.w) OR lower(x.w) IN {DEVELOPMENT} AS weak FROM a",
    "cache_rows": f"WITH {_F}, g AS (SELECT file AS rel, rule, count(DISTINCT id) AS n FROM findings WHERE rule IN {tuple(CHECKED)} GROUP BY 1, 2), k AS (SELECT rel, content_hash, unnest({CHECKED}) AS rule FROM c) SELECT k.rel, k.rule, k.content_hash, coalesce(n, 0) AS findings FROM k LEFT JOIN g ON k.rel = g.rel AND k.rule = g.rule",
    "changed_scope": f"WITH {_E}, {_F}, {_P}, s AS (SELECT coalesce(c.rel, p.rel) AS rel FROM c FULL JOIN p ON c.rel = p.rel WHERE p.rel IS NULL OR c.rel IS NULL OR c.content_hash IS DISTINCT FROM p.content_hash) SELECT rel FROM s UNION SELECT to_rel FROM e WHERE to_rel IS NOT NULL AND from_rel IN (SELECT rel FROM s) UNION SELECT from_rel FROM e WHERE from_rel IS NOT NULL AND to_rel IN (SELECT rel FROM s)",
}


def _rule_scores_sql() -> str:
    from gritstone.plans.text import _LANG

    lang = _LANG.replace("rel,", "file,")
    return f"WITH r AS (SELECT DISTINCT id, rule, confidence, {lang} AS language FROM findings WHERE id IS NOT NULL) SELECT rule, language, grouping(language) AS whole, count(*) AS n, CASE WHEN count(*) >= {LEAST} THEN round(count(*) FILTER (WHERE confidence = 'high') / count(*), 6) END AS share FROM r GROUP BY GROUPING SETS ((rule), (rule, language))"


ORACLE_SQL["rule_scores"] = _rule_scores_sql()


def _assembled_sql() -> str:
    from gritstone.plans import graph, text

    hashed = "substr(sha256(concat_ws(chr(31), 'dead-export', rel, name)), 1, 16)"
    return (
        f"WITH am AS ({text.ORACLE_SQL['agent_markers']}), de AS ({graph.ORACLE_SQL['dead_export']}), cf AS ({graph.ORACLE_SQL['changed_files']}), {_F}, "
        "un AS (SELECT rel FROM c WHERE rel NOT IN (SELECT rel FROM cf)), "
        "al AS (SELECT DISTINCT id, rule, file AS rel, 'stored' AS origin, 1 AS o FROM findings WHERE id IS NOT NULL AND file IN (SELECT rel FROM un) "
        "UNION ALL SELECT id, 'leftover-agent-marker', rel, 'fresh', 2 FROM am WHERE rel NOT IN (SELECT rel FROM un) "
        f"UNION ALL SELECT {hashed}, 'dead-export', rel, 'graph', 3 FROM de) "
        "SELECT id, rule, rel, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, rule, rel) AS k FROM al) WHERE k = 1"
    )


ORACLE_SQL["assembled_findings"] = _assembled_sql()
