"""Queries over packages and advisories, on parts as packages: the brand is the name, the size makes the version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import versions
from gritstone.operators import advisories as A
from gritstone.session import table
from gritstone.sources import lockfiles

# Advisories of the configuration: name, id and ordered events of each range.
ADVISORIES = [
    ("Brand#11", "ADV-1", [("introduced", "0"), ("fixed", "10.2.0")]),
    ("Brand#12", "ADV-2", [("fixed", "30.1"), ("introduced", "20.0.1")]),
    ("Brand#13", "ADV-3", [("introduced", "5"), ("last_affected", "25.3.0")]),
    ("Brand#21", "ADV-4", [("introduced", "40.0.0")]),
    ("Brand#22", "ADV-5", [("introduced", "1.0.0"), ("fixed", "3.0.0"), ("introduced", "10.0.0"), ("fixed", "12.0.0")]),
]


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    return parts.select(F.col("p_partkey").alias("package_id"), F.col("p_brand").alias("name"), version.alias("version"))


def vuln_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(ADVISORIES, "name string, advisory string, events array<struct<kind:string,version:string>>")
    return A.affected(_packages(spark, sf_dir), F.broadcast(listed), versions.semver_key, ["name"]).select("package_id", "advisory", "fix")


def package_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.package_set(_packages(spark, sf_dir), ["name", "version"], "package_id")


def package_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _packages(spark, sf_dir)
    return A.list_hash(rows, "name", F.concat_ws("@", "name", "version"))


def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest and lowest version of each package by number, not by text."""
    rows = _packages(spark, sf_dir).withColumn("key", versions.semver_key(F.col("version")))
    return rows.groupBy("name").agg(F.max_by("version", "key").alias("highest"), F.min_by("version", "key").alias("lowest"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as packages of three ecosystems, with the version shapes of each."""
    parts = table(spark, sf_dir, "part").filter("p_partkey is not null")
    eco = F.element_at(F.array(F.lit("npm"), F.lit("PyPI"), F.lit("Packagist")), (F.col("p_partkey") % 3 + 1).cast("int"))
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))
    third = F.concat(F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    stage = F.col("p_partkey") % 5
    npm = F.concat(number, third, F.when(stage == 0, "-rc.1").otherwise(""))
    pypi = F.concat(number, F.when(stage == 0, "rc1").when(stage == 1, ".post1").otherwise(""))
    composer = F.concat(F.lit("v"), number, third, F.when(stage == 0, "-beta2").when(stage == 1, "-p1").otherwise(""))
    version = F.when(eco == "npm", npm).when(eco == "PyPI", pypi).otherwise(composer)
    name = F.concat(F.regexp_replace("p_brand", "#", F.lit("-")), F.lit("-"), (F.col("p_partkey") % 8).cast("string"))
    return parts.select(F.col("p_partkey").alias("package_id"), eco.alias("ecosystem"), name.alias("name"), version.alias("version"))


def _advisories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as advisories: the batch answer, and the details, which some lack."""
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").filter("s_suppkey is not null")
    eco = F.element_at(F.array(F.lit("npm"), F.lit("PyPI"), F.lit("Packagist")), (s % 3 + 1).cast("int"))
    brand = F.concat((1 + s % 5).cast("string"), (1 + F.expr("s_suppkey div 5") % 5).cast("string"))
    name = F.concat(F.when(eco == "PyPI", F.lit("brand_")).otherwise(F.lit("Brand-")), brand, F.when(eco == "PyPI", F.lit(".")).otherwise(F.lit("-")), (s % 8).cast("string"))
    advisory = F.concat(F.lit("ADV-"), s.cast("string"))
    event = lambda kind, version: F.struct(F.lit(kind).alias("kind"), version.alias("version"))
    low = F.when(s % 11 == 0, "junk").otherwise(F.concat((s % 30).cast("string"), F.lit(".0.0")))
    high = F.concat((s % 30 + 12).cast("string"), F.lit("."), (s % 4).cast("string"), F.lit(".0"))
    events = F.array_compact(F.array(F.when(s % 4 != 0, event("fixed", high)), event("introduced", low)))
    kind = F.when(eco == "npm", "SEMVER").otherwise("ECOSYSTEM")
    commits = F.when(s % 7 == 0, F.struct(F.lit("GIT").alias("type"), events.alias("events")))
    ranges = F.array_compact(F.array(commits, F.struct(kind.alias("type"), events.alias("events"))))
    rating = F.element_at(F.array(*map(F.lit, ("CRITICAL", "High", "moderate", "LOW", "odd"))), (s % 5 + 1).cast("int"))
    return rows.select(eco.alias("ecosystem"), name.alias("name"), advisory.alias("advisory")), rows.filter(s % 13 != 0).select(advisory.alias("advisory"), rating.alias("rating"), ranges.alias("ranges"))


def advisory_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of three ecosystems with the advisories named for them, their severity and what to upgrade to."""
    return A.advised(_listed(spark, sf_dir), *_advisories(spark, sf_dir)).select("package_id", "advisory", "severity", "fix_kind", "fix")


def lock_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock files of six managers written from parts, some fifty a file, and read again."""
    rows = _listed(spark, sf_dir).withColumn("version", F.regexp_replace("version", "^v", ""))
    number = (F.col("package_id") % 6).cast("int")
    rel = F.concat(F.lit("r"), F.expr("package_id div 300").cast("string"), F.lit("/"), F.element_at(F.array(*map(F.lit, lockfiles.LOCKS)), number + 1))
    name, version = F.col("name"), F.col("version")
    entry = F.element_at(
        F.array(
            F.format_string('"node_modules/%s": {"version": "%s"}', name, version),
            F.format_string('"%s@^1", "%s@^2":\n  version "%s"\n  resolved "x"\n', name, name, version),
            F.format_string("  /%s@%s:\n    resolution: {integrity: x}\n", name, version),
            F.format_string('{"name": "%s", "version": "v%s"}', name, version),
            F.format_string('[[package]]\nname = "%s"\nversion = "%s"\n', name, version),
            F.format_string("%s[extra]==%s ; python_version > '3' # pinned", name, version),
        ),
        number + 1,
    )
    joint = F.when(number.isin(0, 3), ", ").otherwise("\n")
    files = rows.select(rel.alias("rel"), number.alias("kind"), "package_id", entry.alias("entry"), joint.alias("joint"))
    # At most fifty entries a file, by the numbers of the parts.
    files = files.groupBy("rel", "kind", "joint").agg(F.array_sort(F.collect_list(F.struct("package_id", "entry"))).alias("entries"))
    body = F.array_join(F.transform("entries", lambda e: e["entry"]), "\x00")
    text = F.replace(body, F.lit("\x00"), F.col("joint"))
    whole = F.when(F.col("kind") == 0, F.concat(F.lit('{"packages": {'), text, F.lit("}}"))).when(F.col("kind") == 3, F.concat(F.lit('{"packages": ['), text, F.lit("]}"))).otherwise(text)
    return lockfiles.packages(files.select("rel", whole.alias("text"))).select("lock_rel", "name", "version", "ecosystem")


QUERIES = {f.__name__: f for f in (vuln_ranges, package_set, package_hash, version_order, advisory_hits, lock_packages)}

_PK = "p AS (SELECT p_partkey AS package_id, p_brand AS name, p_size AS a, p_partkey % 4 AS b, p_partkey % 3 AS c, concat_ws('.', CAST(p_size AS VARCHAR), CAST(p_partkey % 4 AS VARCHAR), CAST(p_partkey % 3 AS VARCHAR)) AS version, p_size * 10000 + (p_partkey % 4) * 100 + p_partkey % 3 AS k FROM part)"

_ECO = "CASE {0} % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Packagist' END"
_LISTED = f"""l AS (SELECT p_partkey AS package_id, {_ECO.format('p_partkey')} AS eco, replace(p_brand, '#', '-') || '-' || (p_partkey % 8) AS name, p_size AS a, p_partkey % 4 AS b, p_partkey % 7 AS c, p_partkey % 5 AS st,
 CASE p_partkey % 3 WHEN 0 THEN p_size || '.' || (p_partkey % 4) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 5 = 0 THEN '-rc.1' ELSE '' END
 WHEN 1 THEN p_size || '.' || (p_partkey % 4) || CASE p_partkey % 5 WHEN 0 THEN 'rc1' WHEN 1 THEN '.post1' ELSE '' END
 ELSE p_size || '.' || (p_partkey % 4) || '.' || (p_partkey % 7) || CASE p_partkey % 5 WHEN 0 THEN '-beta2' WHEN 1 THEN '-p1' ELSE '' END END AS version FROM part WHERE p_partkey IS NOT NULL)"""
# The place of a version as one number: parts, then its stage, a release being 5.
_AT = "((a * 100 + b) * 100 + CASE WHEN l.eco = 'PyPI' THEN 0 ELSE c END) * 10 + CASE WHEN st = 0 THEN 0 WHEN st = 1 AND l.eco <> 'npm' THEN 6 ELSE 5 END"
_HITS = f"""s AS (SELECT s_suppkey AS s, {_ECO.format('s_suppkey')} AS eco, lower('brand-' || (1 + s_suppkey % 5) || (1 + (s_suppkey // 5) % 5) || '-' || (s_suppkey % 8)) AS k FROM supplier WHERE s_suppkey IS NOT NULL),
 h AS (SELECT package_id, s, {_AT} AS v, ((s % 30) * 100 * 100) * 10 + 5 AS lo, (((s % 30 + 12) * 100 + s % 4) * 100) * 10 + 5 AS hi FROM l JOIN s ON l.eco = s.eco AND lower(l.name) = s.k),
 w AS (SELECT *, v >= lo AND (s % 4 = 0 OR v < hi) AS inside FROM h)"""

ORACLE_SQL = {
    "vuln_ranges": f"WITH {_PK} SELECT package_id, 'ADV-1' AS advisory, '10.2.0' AS fix FROM p WHERE name = 'Brand#11' AND k < 100200 UNION ALL SELECT package_id, 'ADV-2', '30.1' FROM p WHERE name = 'Brand#12' AND k >= 200001 AND k < 300100 UNION ALL SELECT package_id, 'ADV-3', NULL FROM p WHERE name = 'Brand#13' AND k >= 50000 AND k <= 250300 UNION ALL SELECT package_id, 'ADV-4', NULL FROM p WHERE name = 'Brand#21' AND k >= 400000 UNION ALL SELECT package_id, 'ADV-5', CASE WHEN k < 30000 THEN '3.0.0' ELSE '12.0.0' END FROM p WHERE name = 'Brand#22' AND (k >= 10000 AND k < 30000 OR k >= 100000 AND k < 120000)",
    "package_set": f"WITH {_PK} SELECT name, version, min(package_id) AS package_id FROM p GROUP BY name, version",
    "package_hash": f"WITH {_PK}, d AS (SELECT DISTINCT name, sha256(concat_ws('@', name, version)) AS h FROM p) SELECT name, sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(f"CAST(sum(CAST('0x' || substr(h, {k}, 15) AS BIGINT)) AS VARCHAR)" for k in (1, 16, 31))})) AS hash, count(*) AS items FROM d GROUP BY name",
    "version_order": f"WITH {_PK} SELECT name, arg_max(version, k) AS highest, arg_min(version, k) AS lowest FROM p GROUP BY name",
    "advisory_hits": f"WITH {_LISTED}, {_HITS} SELECT package_id, 'ADV-' || s AS advisory, CASE WHEN s % 13 = 0 THEN 'low' WHEN s % 5 IN (0, 1) THEN 'high' WHEN s % 5 = 2 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN s % 13 = 0 THEN 'none' WHEN s % 11 = 0 THEN 'unreadable' WHEN inside THEN CASE WHEN s % 4 = 0 THEN 'none' ELSE 'named' END WHEN s % 7 = 0 THEN 'unreadable' ELSE 'outside' END AS fix_kind, CASE WHEN s % 13 <> 0 AND s % 11 <> 0 AND inside AND s % 4 <> 0 THEN (s % 30 + 12) || '.' || (s % 4) || '.0' END AS fix FROM w",
    "lock_packages": f"WITH {_LISTED} SELECT DISTINCT 'r' || (package_id // 300) || '/' || CASE package_id % 6 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'yarn.lock' WHEN 2 THEN 'pnpm-lock.yaml' WHEN 3 THEN 'composer.lock' WHEN 4 THEN 'poetry.lock' ELSE 'requirements.txt' END AS lock_rel, CASE WHEN package_id % 6 IN (4, 5) THEN lower(name) ELSE name END AS name, version, CASE package_id % 6 WHEN 3 THEN 'Packagist' WHEN 4 THEN 'PyPI' WHEN 5 THEN 'PyPI' ELSE 'npm' END AS ecosystem FROM l",
}
