"""Queries over source text: files, lines, names and line rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import scalar as S
from gritstone.functions import secrets
from gritstone.operators import imports, verdict
from gritstone.plans.findings import _LINES
from gritstone.plans.resolution import resolver_sql
from gritstone.session import table

MARKER = r"\b(?:TODO|FIXME|HACK|XXX)\b"
ISSUE = r"https?://|#[0-9]+|\b[A-Z]{2,}-[0-9]+\b"
COMMENT = r"^\s*(?://|#|/\*|\*)"
DEBUG = r"\bconsole\.(?:log|debug|trace|dir|table)\(|\bdebugger;|\bvar_dump\(|\bbreakpoint\(\)"
WEAK = r"\bMath\.random\(\)|\b(?:md5|sha1)\b"
LOGGER_CALLS = 20  # a file that logs so often is a logger
IMPORT = r"\bfrom\s+['\"][^'\"]+['\"]|\brequire\(['\"][^'\"]+['\"]\)|^import\s+['\"][^'\"]+['\"]"
NAMED = r"(?m)^import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}"
# Statements that import or re-export; their names may stand on several lines.
WHOLE_IMPORT = r"(?m)^\s*import\b[^'\";]*['\"][^'\"\n]+['\"]"
STATEMENTS = {
    "import": r"(?m)^[ \t]*import\s*(?:type\b)?([^'\"`;()=]*?)(?:\bfrom\s*)?['\"]([^'\"\n]+)['\"]",
    "reexport": r"(?m)^[ \t]*export\s*(?:type\b)?\s*(\*[^'\"`;()=]*?|\{[^}]*\}\s*)\bfrom\s*['\"]([^'\"\n]+)['\"]",
    "require": r"()\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)",
    "dynamic": r"()\bimport\(\s*['\"]([^'\"\n]+)['\"]\s*\)",
}
DECLARED = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s+|const\s+|class\s+|def\s+)([A-Za-z_$][\w$]*)"
LITERAL = r"['\"]([A-Za-z0-9+/=_.-]{16,80})['\"]"
BASIC = r"\b[Bb]asic\s+([A-Za-z0-9+/]{8,}={0,2})"
INTENT = "a function to load the handleOf a frame"
PARAMETERS = 2  # that the function looked for takes
SYMBOL = r"^(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|const|let|var|class|type|interface|enum|def)\b\s*\*?\s*([A-Za-z_$][\w$]*)"
TEST_FILE = r"(^|/)__tests__/|\.(?:test|spec)\."
TEST_FOLDER = r"(^|/)(?:test|tests|__tests__|spec)/|[._-](?:test|spec)\.[^/]*$"

# Endings and the language each stands for; declaration files have none.
LANGUAGE_CASES = (
    (r"\.d\.[mc]?ts$|\.pyi$", None),
    (r"\.tsx$", "tsx"),
    (r"\.[mc]?ts$", "typescript"),
    (r"\.(?:[mc]?js|jsx)$", "javascript"),
    (r"\.(?:php|phtml)$", "php"),
    (r"\.py$", "python"),
)


def language(rel: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(LANGUAGE_CASES):
        out = F.when(rel.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, source) as delivered: doubled rows are told apart in the small result, so no text is shuffled."""
    return table(spark, sf_dir, "parsed_files").filter("rel is not null and source is not null").select("rel", "source")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that rules look at: of the languages of code and not marked as broken; an unknown mark is none."""
    rows = table(spark, sf_dir, "parsed_files").filter("rel is not null and source is not null and not coalesce(has_error, false)")
    return rows.filter(language(F.col("rel")).isNotNull()).select("rel", "source")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).filter(language(F.col("rel")).isin("typescript", "tsx", "javascript"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, text) of every line of every file, from 1; a doubled row gives its lines twice."""
    rows = _texts(spark, sf_dir).select("rel", F.posexplode(S.lines(F.col("source"))).alias("pos", "text"))
    return rows.select("rel", (F.col("pos") + 1).cast("long").alias("line"), "text")


def _with_lines(texts: DataFrame) -> DataFrame:
    """(rel, lines): the lines of a file stay one row, so rules on neighbouring lines move nothing."""
    return texts.select("rel", S.lines(F.col("source")).alias("lines"))


def _hits(flags: Column) -> Column:
    """The numbers, from 1, of the true elements."""
    return F.array_compact(F.transform(flags, lambda x, i: F.when(x, (i + 1).cast("long"))))


def _next(lines: Column) -> Column:
    """Every line's next one; null behind the last."""
    return F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit(None).cast("string")))


def _lines_where(texts: DataFrame, matches) -> DataFrame:
    """(rel, line) of lines that match on their own."""
    hits = _hits(F.transform("lines", matches))
    return _with_lines(texts).select("rel", F.explode(hits).alias("line")).distinct()


def files_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir)
    return rows.select("rel", language(F.col("rel")).alias("language"), F.sha2("source", 256).alias("content_hash"), F.octet_length("source").cast("long").alias("size")).distinct()


def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of languages that their repository reads; PHP and Python only where it says so."""
    files = _texts(spark, sf_dir).select("rel", language(F.col("rel")).alias("language"), F.substring_index("rel", "/", 1).alias("repo")).filter("language is not null").distinct()
    repos = table(spark, sf_dir, "repos").groupBy("repo").agg(F.max("php_enabled").alias("php"), F.max("python_enabled").alias("python"))
    rows = files.join(repos, "repo", "left")
    on = F.when(F.col("language") == "php", F.coalesce("php", F.lit(False))).when(F.col("language") == "python", F.coalesce("python", F.lit(False))).otherwise(True)
    return rows.filter(on).select("rel", "language")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each file, and how many are comments or blank; counted inside the row."""
    count = lambda pattern: F.size(F.filter("lines", lambda t: t.rlike(pattern))).cast("long")
    longest = F.array_max(F.transform("lines", F.length)).cast("long")
    return _with_lines(_texts(spark, sf_dir)).select("rel", F.size("lines").cast("long").alias("lines"), count(COMMENT).alias("comments"), count(r"^\s*$").alias("blanks"), longest.alias("longest")).distinct()


def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of a file with their ordinal; what travels is the hash of a line, not its text."""
    hashes = F.transform("lines", lambda t: F.sha2(S.trimmed(t), 256))
    rows = _with_lines(_texts(spark, sf_dir)).select("rel", F.posexplode(hashes).alias("pos", "text")).distinct()
    rows = rows.select("rel", "text", (F.col("pos") + 1).cast("long").alias("line"))
    return verdict.with_ordinals(rows, "rel").filter("ordinal > 0").select("rel", "line", F.col("ordinal").cast("long"))


def _identified(texts: DataFrame, rule: str, matches) -> DataFrame:
    """(rel, line, id) of lines that match; the id survives moved lines, as it holds the line's text and how many like it come before."""
    hits = F.array_compact(F.transform("lines", lambda t, i: F.when(matches(t), F.struct(i.alias("at"), S.trimmed(t).alias("text")))))
    # Only hits look back over the lines before them.
    ordinal = lambda h: F.size(F.filter(F.slice("lines", F.lit(1), h["at"].cast("int")), lambda t: S.trimmed(t) == h["text"]))
    marked = F.transform("hits", lambda h: F.struct((h["at"] + 1).cast("long").alias("line"), h["text"].alias("text"), ordinal(h).alias("ordinal")))
    rows = _with_lines(texts).select("rel", "lines", hits.alias("hits")).filter("size(hits) > 0").select("rel", F.explode(marked).alias("h"))
    return verdict.identified(rows.select("rel", "h.*"), rule).select("rel", "line", "id").distinct()


def agent_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines with a work marker and no issue to go with it; the id survives moved lines."""
    return _identified(_texts(spark, sf_dir), "leftover-agent-marker", lambda t: t.rlike(COMMENT) & t.rlike(MARKER) & ~t.rlike(ISSUE))


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, text) of the lines that findings quote, some of them from older versions of a file."""
    rows = table(spark, sf_dir, "findings").filter("evidence is not null and file is not null")
    return rows.select(F.col("file").alias("rel"), F.col("span.start_line").cast("long").alias("line"), F.col("evidence").alias("text"))


def _now_or_quoted(spark: SparkSession, sf_dir: str, matches) -> DataFrame:
    """(rel, line) of lines that match in the present text of a sound file or in what a finding quotes of an earlier one."""
    now = _lines_where(_clean(spark, sf_dir), matches)
    return now.union(_quoted(spark, sf_dir).filter(matches(F.col("text"))).select("rel", "line")).distinct()


def leftover_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a debugging call, now or when a finding quoted them, outside scripts and tests, unless the file logs for a living."""
    rows = _now_or_quoted(spark, sf_dir, lambda t: t.rlike(DEBUG) & ~t.rlike(COMMENT))
    rows = rows.filter(~F.col("rel").rlike(TEST_FOLDER) & ~S.matches_any(F.col("rel"), ["**/scripts/**", "**/*.config.*", "**/bin/**"]))
    loggers = rows.groupBy("rel").agg(F.count("*").alias("calls")).filter(F.col("calls") >= LOGGER_CALLS)
    return rows.join(loggers, "rel", "left_anti").select("rel", "line")


def comment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three and more comment lines, found inside the row."""
    flags = F.transform("lines", lambda t: t.rlike(COMMENT))
    rows = _with_lines(_texts(spark, sf_dir)).select("rel", flags.alias("flags"))
    before = F.concat(F.array(F.lit(False)), F.slice("flags", F.lit(1), F.size("flags") - 1))
    after = F.concat(F.slice("flags", F.lit(2), F.size("flags")), F.array(F.lit(False)))
    edge = lambda other: _hits(F.zip_with("flags", other, lambda a, b: a & ~b))
    runs = F.zip_with(edge(before), edge(after), lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("length")))
    return rows.select("rel", F.explode(runs).alias("r")).filter("r.length >= 3").select("rel", "r.first", "r.length").distinct()


def weak_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a weak source of randomness or digest, now or when a finding quoted them; comments do not count."""
    return _now_or_quoted(spark, sf_dir, lambda t: t.rlike(WEAK) & ~t.rlike(COMMENT))


def swallowed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch clauses of sound files that only give back null: the same or the next line tells."""
    empty = lambda t: t.rlike(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*(?:return null;?\s*)?\}")
    head = lambda t: t.rlike(r"\bcatch\b[^{}]*\{\s*$|^\s*except\b[^#]*:\s*$")
    flags = F.zip_with("lines", _next(F.col("lines")), lambda a, b: empty(a) | head(a) & F.coalesce(b.rlike(r"^\s*(?:return null;?|return None|pass|\})\s*$"), F.lit(False)))
    return _with_lines(_clean(spark, sf_dir)).select("rel", F.explode(_hits(flags)).alias("line")).distinct()


def import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, specifier) of every import, re-export and require, each of several on a line."""
    rows = source_lines(spark, sf_dir).select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(IMPORT), 0)).alias("import"))
    return rows.select("rel", "line", F.regexp_extract("import", r"['\"]([^'\"]+)['\"]", 1).alias("specifier")).distinct()


def _pieces(clause: Column) -> Column:
    """The pieces between the commas of an import's braces."""
    return F.filter(F.transform(F.split(clause, ","), S.trimmed), lambda p: p != "")


def unused_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, name) imported by name, on one line or several, and not read again in the file; worked out inside the row."""
    local = lambda p: F.regexp_extract(p, r"([\w$]+)$", 1)
    names = F.transform(F.flatten(F.transform(F.regexp_extract_all("source", F.lit(NAMED), 1), _pieces)), local)
    used = F.regexp_extract_all(F.regexp_replace("source", WHOLE_IMPORT, ""), F.lit(r"([A-Za-z_$][\w$]*)"), 1)
    unread = F.filter(F.array_except(names, used), lambda n: n != "")
    return _scripts(spark, sf_dir).select("rel", F.explode(unread).alias("name")).distinct()


def made_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, specifier, name, kind) of every import of a script, one row per imported name.

    A default import is called default, a whole module ``*``, and an import for its
    effects has an empty name. A re-export names what it takes from the other file.
    """
    found = []
    for kind, pattern in STATEMENTS.items():
        found.append(F.transform(F.regexp_extract_all("source", F.lit(pattern), 0), lambda m: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(m, pattern, 1).alias("clause"), F.regexp_extract(m, pattern, 2).alias("specifier"))))  # noqa: B023
    rows = _scripts(spark, sf_dir).select("rel", F.explode(F.concat(*found)).alias("s")).select("rel", "s.*")
    clause = F.col("clause")
    braces = _pieces(F.regexp_extract(clause, r"\{([^}]*)\}", 1))
    taken = F.transform(braces, lambda p: F.regexp_extract(p, r"^(?:type\s+)?([\w$]+)", 1))
    default = F.regexp_extract(clause, r"^\s*(?:type\s+)?([\w$]+)", 1) != ""
    names = F.concat(F.when(default & (F.col("kind") == "import"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>")), F.when(clause.contains("*") | F.col("kind").isin("require", "dynamic"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")), taken)
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("")))
    return rows.select("rel", "specifier", "kind", F.explode(names).alias("name")).distinct()


def made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_rel, to_rel, specifier, name, kind): edges made anew from the imports of the present texts.

    Relative specifiers go through the resolver against the files with a text;
    others name packages and have no target.
    """
    rows = made_imports(spark, sf_dir).withColumnRenamed("rel", "from_rel")
    keyed = rows.withColumn("edge_id", F.struct("from_rel", "specifier"))
    found = imports.resolved(keyed.select("edge_id", "from_rel", "specifier").distinct(), table(spark, sf_dir, "parsed_files").filter("rel is not null"))
    found = found.select(F.col("edge_id.from_rel").alias("from_rel"), F.col("edge_id.specifier").alias("specifier"), F.col("target").alias("to_rel"))
    return rows.join(found, ["from_rel", "specifier"], "left").select("from_rel", "to_rel", "specifier", "name", "kind")


def declared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, name, exported) declared at the left margin."""
    rows = source_lines(spark, sf_dir).filter(F.col("text").rlike(DECLARED))
    return rows.select("rel", "line", F.regexp_extract("text", DECLARED, 1).alias("name"), F.col("text").startswith("export").alias("exported")).distinct()


def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, name) that scripts export: declarations marked so, and names of export lists under the name they go by outside."""
    lists = F.flatten(F.transform(F.regexp_extract_all("source", F.lit(r"(?m)^export\s*\{([^}]*)\}"), 1), _pieces))
    listed = F.transform(lists, lambda p: F.regexp_extract(p, r"([\w$]+)$", 1))
    declared = F.regexp_extract_all("source", F.lit(r"(?m)^export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|const|let|var|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)"), 1)
    default = F.when(F.col("source").rlike(r"(?m)^export\s+default\b"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    return _scripts(spark, sf_dir).select("rel", F.explode(F.concat(declared, listed, default)).alias("name")).filter("name <> ''").distinct()


def declared_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, kind, name, exported) of what is declared at the left margin, types and enumerations too."""
    rows = source_lines(spark, sf_dir).filter(F.col("text").rlike(SYMBOL))
    part = lambda k: F.regexp_extract("text", SYMBOL, k)
    return rows.select("rel", "line", part(2).alias("kind"), part(3).alias("name"), (part(1) != "").alias("exported")).distinct()


def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten functions that fit an intent best: of the wanted number of parameters first, then by shared words, then by place.

    An unknown number of parameters fits nothing; functions without a shared word are none.
    """
    rows = table(spark, sf_dir, "function_records").filter("name is not null").select("id", "file", "name", "start_line", "param_count").distinct()
    rows = rows.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(S.identifier_words(F.col("name"))), S.telling_words(F.lit(INTENT)))).cast("long"))
    fits = F.coalesce(F.col("param_count") == PARAMETERS, F.lit(False))
    rows = rows.filter("overlap > 0").withColumn("fits", fits)
    return rows.orderBy(F.desc("fits"), F.desc("overlap"), "file", "start_line", "name", "id").limit(10).select("id", "name", "fits", "overlap")


def name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions have each word in their name."""
    rows = table(spark, sf_dir, "function_records").filter("name is not null").select("id", "name").distinct()
    words = rows.select("id", F.explode(F.array_distinct(S.identifier_words(F.col("name")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("functions"))


def entropy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct string literals of 24 to 80 letters and digits with their entropy."""
    literal = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"['\"]([A-Za-z0-9+/=_-]{24,80})['\"]"), 1)))
    rows = _texts(spark, sf_dir).select("rel", F.explode(S.lines(F.col("source"))).alias("text")).select("rel", literal.alias("value")).distinct()
    return rows.select("rel", S.masked(F.col("value")).alias("mask"), F.sha2("value", 256).alias("hash"), F.round(S.shannon(F.col("value")), 6).alias("entropy"))


def generated_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct long string literals and whether they look generated, or are filler."""
    literal = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(LITERAL), 1)))
    rows = _texts(spark, sf_dir).select("rel", F.explode(S.lines(F.col("source"))).alias("text")).select("rel", literal.alias("value")).distinct()
    return rows.select("rel", F.sha2("value", 256).alias("hash"), secrets.looks_generated(F.col("value")).alias("generated"), secrets.is_filler(F.col("value")).alias("filler"))


def basic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel, line, pair) of basic headers in text and quoted lines, and whether each decodes to a user and a password."""
    lines = source_lines(spark, sf_dir).union(_quoted(spark, sf_dir))
    rows = lines.select("rel", "line", F.explode(F.regexp_extract_all("text", F.lit(BASIC), 1)).alias("value")).distinct()
    return rows.select("rel", "line", secrets.decodes_to_a_pair(F.col("value")).alias("pair"))


def gated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of files in a language that their repository reads."""
    read = language_gate(spark, sf_dir).select(F.col("rel").alias("file")).distinct()
    return verdict.one_per_id(table(spark, sf_dir, "findings")).join(read, "file", "left_semi").select("id", "file")


def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two notions of a test file, and the path without its ending."""
    rows = _texts(spark, sf_dir).select("rel").distinct()
    return rows.select("rel", F.col("rel").rlike(TEST_FILE).alias("test_file"), F.col("rel").rlike(TEST_FOLDER).alias("test_folder"), S.without_ending(F.col("rel")).alias("stem"))


QUERIES = {
    f.__name__: f
    for f in (files_index, language_gate, line_counts, line_ordinals, agent_markers, leftover_debug, comment_blocks, weak_random, swallowed_errors, import_lines, unused_imports, made_imports, made_edges, declared_names, declared_symbols, exported_names, symbol_search, name_words, entropy_gate, generated_literals, basic_pairs, gated_findings, path_predicates)
}

_LANG = r"""CASE WHEN regexp_matches(rel, '\.d\.[mc]?ts$|\.pyi$') THEN NULL WHEN regexp_matches(rel, '\.tsx$') THEN 'tsx' WHEN regexp_matches(rel, '\.[mc]?ts$') THEN 'typescript'
 WHEN regexp_matches(rel, '\.(?:[mc]?js|jsx)$') THEN 'javascript' WHEN regexp_matches(rel, '\.(?:php|phtml)$') THEN 'php' WHEN regexp_matches(rel, '\.py$') THEN 'python' END"""
_SRC = "s AS (SELECT DISTINCT rel, source FROM parsed_files WHERE rel IS NOT NULL AND source IS NOT NULL)"
_CLEAN = f"p AS (SELECT DISTINCT rel, source FROM parsed_files WHERE rel IS NOT NULL AND source IS NOT NULL AND NOT coalesce(has_error, false)), q AS (SELECT rel, source, {_LANG} AS lang FROM p), s AS (SELECT rel, source FROM q WHERE lang IS NOT NULL), j AS (SELECT rel, source FROM q WHERE lang IN ('typescript', 'tsx', 'javascript'))"
_CLEAN_LINES = _CLEAN + r""", lines AS (SELECT rel, i AS line, parts[i] AS text FROM (SELECT rel, string_split_regex(regexp_replace(source, '\r?\n$', ''), '\r?\n') AS parts FROM s) x, LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""
_NOW = "now AS (SELECT rel, line, text FROM lines UNION ALL SELECT file, CAST(span.start_line AS BIGINT), evidence FROM findings WHERE evidence IS NOT NULL AND file IS NOT NULL)"
_Q = DEBUG.replace("'", "''")
_ISLANDS = f"""r AS (SELECT rel, line, regexp_matches(text, '{COMMENT}') AS c FROM lines), i AS (SELECT rel, line, c, row_number() OVER (PARTITION BY rel ORDER BY line) - row_number() OVER (PARTITION BY rel, c ORDER BY line) AS g FROM r)"""
_WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"

_WHOLE = WHOLE_IMPORT.replace("'", "''")


def _statement_sql(kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    m = f"SELECT rel, unnest(regexp_extract_all(source, '{p}', 0)) AS m FROM j"
    return f"SELECT rel, '{kind}' AS kind, regexp_extract(m, '{p}', 1) AS clause, regexp_extract(m, '{p}', 2) AS specifier FROM ({m})"


_PIECE = r"list_filter(list_transform(string_split(regexp_extract(clause, '\{([^}]*)\}', 1), ','), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_MADE = (
    f"st AS ({' UNION ALL '.join(_statement_sql(k, p) for k, p in STATEMENTS.items())}), "
    rf"nm AS (SELECT rel, kind, specifier, list_concat(CASE WHEN kind = 'import' AND regexp_extract(clause, '^\s*(?:type\s+)?([\w$]+)', 1) <> '' THEN ['default'] ELSE [] END, CASE WHEN contains(clause, '*') OR kind IN ('require', 'dynamic') THEN ['*'] ELSE [] END, list_transform({_PIECE}, lambda p: regexp_extract(p, '^(?:type\s+)?([\w$]+)', 1))) AS names FROM st), "
    "made AS (SELECT DISTINCT rel, kind, specifier, unnest(CASE WHEN len(names) > 0 THEN names ELSE [''] END) AS name FROM nm)"
)
_EXPORTED = r"""x AS (SELECT rel, unnest(regexp_extract_all(source, '(?m)^export\s+(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|const|let|var|class|interface|type|enum)\s+([A-Za-z_$][\w$]*)', 1)) AS name FROM j
 UNION SELECT rel, name FROM (SELECT rel, regexp_extract(unnest(string_split(clause, ',')), '([\w$]+)\s*$', 1) AS name FROM (SELECT rel, unnest(regexp_extract_all(source, '(?m)^export\s*\{([^}]*)\}', 1)) AS clause FROM j)) WHERE name <> ''
 UNION SELECT rel, 'default' FROM j WHERE regexp_matches(source, '(?m)^export\s+default\b'))"""

ORACLE_SQL = {
    "files_index": f"WITH {_SRC} SELECT rel, {_LANG} AS language, sha256(source) AS content_hash, CAST(octet_length(encode(source)) AS BIGINT) AS size FROM s",
    "language_gate": f"WITH {_SRC}, g AS (SELECT rel, {_LANG} AS language, split_part(rel, '/', 1) AS repo FROM s), r AS (SELECT repo, bool_or(php_enabled) AS php, bool_or(python_enabled) AS py FROM repos GROUP BY repo) SELECT rel, language FROM g LEFT JOIN r USING (repo) WHERE language IS NOT NULL AND CASE language WHEN 'php' THEN coalesce(php, false) WHEN 'python' THEN coalesce(py, false) ELSE true END",
    "line_counts": rf"WITH {_LINES} SELECT rel, count(*) AS lines, count(*) FILTER (WHERE regexp_matches(text, '{COMMENT}')) AS comments, count(*) FILTER (WHERE regexp_matches(text, '^\s*$')) AS blanks, CAST(max(length(text)) AS BIGINT) AS longest FROM lines GROUP BY rel",
    "line_ordinals": rf"WITH {_LINES} SELECT rel, line, ordinal FROM (SELECT rel, line, row_number() OVER (PARTITION BY rel, regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY line) - 1 AS ordinal FROM lines) WHERE ordinal > 0",
    "agent_markers": rf"WITH {_LINES}, o AS (SELECT rel, line, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, row_number() OVER (PARTITION BY rel, regexp_replace(text, '^\s+|\s+$', '', 'g') ORDER BY line) - 1 AS n FROM lines) SELECT rel, line, substr(sha256(concat_ws(chr(31), 'leftover-agent-marker', rel, concat_ws(chr(31), t, CAST(n AS VARCHAR)))), 1, 16) AS id FROM o WHERE regexp_matches(text, '{COMMENT}') AND regexp_matches(text, '{MARKER}') AND NOT regexp_matches(text, '{ISSUE}')",
    "leftover_debug": rf"WITH {_CLEAN_LINES}, {_NOW}, d AS (SELECT rel, line, count(*) OVER (PARTITION BY rel) AS calls FROM (SELECT DISTINCT rel, line FROM now WHERE regexp_matches(text, '{_Q}') AND NOT regexp_matches(text, '{COMMENT}') AND NOT regexp_matches(rel, '{TEST_FOLDER}') AND NOT regexp_matches(rel, '^(?:.*/)?scripts/.*$|^(?:.*/)?.*\.config\..*$|^(?:.*/)?bin/.*$'))) SELECT rel, line FROM d WHERE calls < 20",
    "comment_blocks": f"WITH {_LINES}, {_ISLANDS} SELECT rel, min(line) AS first, count(*) AS length FROM i WHERE c GROUP BY rel, g HAVING count(*) >= 3",
    "weak_random": rf"WITH {_CLEAN_LINES}, {_NOW} SELECT DISTINCT rel, line FROM now WHERE regexp_matches(text, '{WEAK}') AND NOT regexp_matches(text, '{COMMENT}')",
    "swallowed_errors": rf"WITH {_CLEAN_LINES}, n AS (SELECT rel, line, text, lead(text) OVER (PARTITION BY rel ORDER BY line) AS after FROM lines) SELECT rel, line FROM n WHERE regexp_matches(text, '\bcatch\s*(?:\([^)]*\))?\s*\{{\s*(?:return null;?\s*)?\}}') OR regexp_matches(text, '\bcatch\b[^{{}}]*\{{\s*$|^\s*except\b[^#]*:\s*$') AND coalesce(regexp_matches(after, '^\s*(?:return null;?|return None|pass|\}})\s*$'), false)",
    "import_lines": rf"""WITH {_LINES}, m AS (SELECT rel, line, unnest(regexp_extract_all(text, '{IMPORT.replace("'", "''")}', 0)) AS i FROM lines) SELECT DISTINCT rel, line, regexp_extract(i, '[''"]([^''"]+)[''"]', 1) AS specifier FROM m""",
    "unused_imports": rf"""WITH {_CLEAN}, n AS (SELECT rel, unnest(regexp_extract_all(source, '{NAMED}', 1)) AS clause FROM j), w AS (SELECT DISTINCT rel, regexp_extract(unnest(string_split(clause, ',')), '([\w$]+)\s*$', 1) AS name FROM n), u AS (SELECT DISTINCT rel, unnest(regexp_extract_all(regexp_replace(source, '{_WHOLE}', '', 'g'), '([A-Za-z_$][\w$]*)', 1)) AS name FROM j) SELECT rel, name FROM w WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM u WHERE u.rel = w.rel AND u.name = w.name)""",
    "declared_names": rf"WITH {_LINES} SELECT rel, line, regexp_extract(text, '{DECLARED}', 1) AS name, starts_with(text, 'export') AS exported FROM lines WHERE regexp_matches(text, '{DECLARED}')",
    "made_imports": f"WITH {_CLEAN}, {_MADE} SELECT rel, specifier, name, kind FROM made",
    "made_edges": f"WITH {_CLEAN}, {_MADE}, files AS (SELECT rel FROM parsed_files), e AS (SELECT DISTINCT rel || chr(31) || specifier AS edge_id, rel AS from_rel, specifier FROM made), {resolver_sql('e')} SELECT made.rel AS from_rel, target AS to_rel, made.specifier AS specifier, name, kind FROM made LEFT JOIN resolved ON resolved.edge_id = made.rel || chr(31) || made.specifier",
    "exported_names": rf"WITH {_CLEAN}, {_EXPORTED} SELECT rel, name FROM x",
    "symbol_search": f"WITH f AS (SELECT DISTINCT id, file, name, start_line, param_count FROM function_records WHERE name IS NOT NULL), o AS (SELECT *, CAST(len(list_intersect(list_distinct({_WORDS}), ['load', 'handle', 'frame'])) AS BIGINT) AS overlap, coalesce(param_count = 2, false) AS fits FROM f) SELECT id, name, fits, overlap FROM o WHERE overlap > 0 ORDER BY fits DESC, overlap DESC, file, start_line, name, id LIMIT 10",
    "declared_symbols": rf"WITH {_LINES}, d AS (SELECT DISTINCT rel, line, text FROM lines WHERE regexp_matches(text, '{SYMBOL}')) SELECT DISTINCT rel, line, regexp_extract(text, '{SYMBOL}', 2) AS kind, regexp_extract(text, '{SYMBOL}', 3) AS name, regexp_extract(text, '{SYMBOL}', 1) <> '' AS exported FROM d",
    "name_words": f"WITH f AS (SELECT DISTINCT id, name FROM function_records WHERE name IS NOT NULL), w AS (SELECT DISTINCT id, unnest({_WORDS}) AS word FROM f) SELECT word, count(*) AS functions FROM w GROUP BY word",
    "entropy_gate": rf"""WITH {_LINES}, v AS (SELECT DISTINCT rel, unnest(regexp_extract_all(text, '[''"]([A-Za-z0-9+/=_-]{{24,80}})[''"]', 1)) AS value FROM lines), c AS (SELECT rel, value, unnest(string_split(value, '')) AS ch FROM v), n AS (SELECT rel, value, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY rel, value, ch) SELECT rel, concat(substr(value, 1, 4), '...(', CAST(length(value) AS VARCHAR), ' chars)') AS mask, sha256(value) AS hash, round(-sum(k / CAST(length(value) AS DOUBLE) * log2(k / CAST(length(value) AS DOUBLE))), 6) AS entropy FROM n GROUP BY rel, value""",
    "generated_literals": rf"""WITH {_LINES}, v AS (SELECT DISTINCT rel, unnest(regexp_extract_all(text, '{LITERAL.replace("'", "''")}', 1)) AS value FROM lines), c AS (SELECT rel, value, unnest(string_split(value, '')) AS ch FROM v), n AS (SELECT rel, value, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY rel, value, ch), e AS (SELECT rel, value, -sum(k / CAST(length(value) AS DOUBLE) * log2(k / CAST(length(value) AS DOUBLE))) AS bits FROM n GROUP BY rel, value), w AS (SELECT *, array_to_string(list_transform(range(1, length(value)), lambda i: CASE ascii(substr(value, i + 1, 1)) - ascii(substr(value, i, 1)) WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END), '') AS walk FROM e) SELECT rel, sha256(value) AS hash, length(value) >= 20 AND NOT (contains(value, '://') OR starts_with(value, 'www.') OR regexp_matches(value, '{secrets.PATH}') OR contains(substr(value || value, 2, 2 * length(value) - 2), value) OR contains(walk, '+++++') OR contains(walk, '-----') OR regexp_matches(value, '{secrets.STAND_IN}')) AND (regexp_matches(value, '[a-z]')::INT + regexp_matches(value, '[A-Z]')::INT + regexp_matches(value, '[0-9]')::INT + regexp_matches(value, '[^A-Za-z0-9]')::INT) >= 3 AND round(bits, 9) >= 3.5 AS generated, round(bits, 9) < 2.0 AS filler FROM w""",
    "basic_pairs": rf"WITH {_LINES}, a AS (SELECT rel, line, text FROM lines UNION ALL SELECT file, CAST(span.start_line AS BIGINT), evidence FROM findings WHERE evidence IS NOT NULL AND file IS NOT NULL), v AS (SELECT DISTINCT rel, line, unnest(regexp_extract_all(text, '{BASIC}', 1)) AS value FROM a) SELECT rel, line, coalesce(regexp_matches(try(decode(from_base64(value))), '^[ -9;-~]+:[ -~]+$'), false) AS pair FROM v",
    "gated_findings": f"WITH {_SRC}, g AS (SELECT rel, {_LANG} AS language, split_part(rel, '/', 1) AS repo FROM s), r AS (SELECT repo, bool_or(php_enabled) AS php, bool_or(python_enabled) AS py FROM repos GROUP BY repo), k AS (SELECT rel FROM g LEFT JOIN r USING (repo) WHERE language IS NOT NULL AND CASE language WHEN 'php' THEN coalesce(php, false) WHEN 'python' THEN coalesce(py, false) ELSE true END) SELECT DISTINCT id, file FROM findings WHERE id IS NOT NULL AND file IN (SELECT rel FROM k)",
    "path_predicates": rf"WITH s AS (SELECT DISTINCT rel FROM parsed_files WHERE rel IS NOT NULL AND source IS NOT NULL) SELECT rel, regexp_matches(rel, '{TEST_FILE}') AS test_file, regexp_matches(rel, '{TEST_FOLDER}') AS test_folder, regexp_replace(rel, '\.[^./]*$', '') AS stem FROM s",
}
