"""Lock files of six package managers as rows (lock_rel, name, version, line, ecosystem).

Input is (rel, text) with one row per lock file, as ``repository.text_files`` gives
it. Each file is taken apart by built-in expressions; line formats are exploded
into lines and a window carries the last header down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.scalar import lines, python_name

# The file each manager writes and the ecosystem of its names.
LOCKS = {
    "package-lock.json": "npm",
    "yarn.lock": "npm",
    "pnpm-lock.yaml": "npm",
    "composer.lock": "Packagist",
    "poetry.lock": "PyPI",
    "requirements.txt": "PyPI",
}


def _named(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.element_at(F.split("rel", "/"), -1) == name).select(F.col("rel").alias("lock_rel"), "text")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("lock_rel", F.posexplode(lines(F.col("text"))).alias("pos", "text")).withColumn("line", (F.col("pos") + 1).cast("int")).drop("pos")


def _packages(rows: DataFrame, ecosystem: str) -> DataFrame:
    return rows.filter("name <> '' and version <> ''").select("lock_rel", "name", "version", F.col("line").cast("int"), F.lit(ecosystem).alias("ecosystem"))


def npm(files: DataFrame) -> DataFrame:
    """The ``packages`` map; links and folders of the workspace itself are no packages."""
    schema = "packages map<string, struct<version: string, link: boolean>>"
    rows = _named(files, "package-lock.json").select("lock_rel", F.explode(F.from_json("text", schema)["packages"]).alias("at", "p"))
    rows = rows.filter(F.col("at").contains("node_modules/") & ~F.coalesce("p.link", F.lit(False)))
    return _packages(rows.select("lock_rel", F.substring_index("at", "node_modules/", -1).alias("name"), F.col("p.version").alias("version"), F.lit(0).alias("line")), "npm")


def composer(files: DataFrame) -> DataFrame:
    """Both package lists; branch aliases are no versions."""
    item = "array<struct<name: string, version: string>>"
    parsed = F.from_json("text", f"packages {item}, `packages-dev` {item}")
    none = F.array().cast(item)
    rows = _named(files, "composer.lock").select("lock_rel", F.explode(F.concat(F.coalesce(parsed["packages"], none), F.coalesce(parsed["packages-dev"], none))).alias("p"))
    rows = rows.select("lock_rel", F.col("p.name").alias("name"), F.regexp_replace("p.version", "^v", "").alias("version"), F.lit(0).alias("line"))
    return _packages(rows.filter(~F.col("version").rlike("^dev-|-dev$")), "Packagist")


def _blocks(rows: DataFrame, header: Column, value: Column) -> DataFrame:
    """(lock_rel, name, version, line): the first value line under each header line."""
    w = Window.partitionBy("lock_rel").orderBy("line")
    head = F.last(F.when(header != "", F.struct(header.alias("name"), "line")), ignorenulls=True).over(w)
    rows = rows.select("lock_rel", "line", head.alias("head"), value.alias("version")).filter("version <> '' and head is not null")
    return rows.groupBy("lock_rel", "head").agg(F.min_by("version", "line").alias("version")).select("lock_rel", "head.name", "version", "head.line")


def yarn(files: DataFrame) -> DataFrame:
    """Headers at the margin that end in a colon, then the first version line."""
    text = F.col("text")
    rows = _lines(_named(files, "yarn.lock"))
    header = F.when(text.rlike(r"^[^\s#].*:$"), F.regexp_extract(text, r"^\"?(@?[^@\"]+)@", 1)).otherwise("")
    return _packages(_blocks(rows, header, F.regexp_extract(text, r"^\s+version:?\s+\"?([^\"\s]+)", 1)), "npm")


def pnpm(files: DataFrame) -> DataFrame:
    """Keys two blanks deep: an optional slash, the name, the version, perhaps peers in brackets."""
    rows = _lines(_named(files, "pnpm-lock.yaml"))
    shape = r"^  ['\"]?/?(@?[^@\s'\"]+)[@/](\d[^(:'\"]*)[^:]*:\s*$"
    rows = rows.select("lock_rel", F.regexp_extract("text", shape, 1).alias("name"), F.regexp_extract("text", shape, 2).alias("version"), "line")
    return _packages(rows, "npm")


def poetry(files: DataFrame) -> DataFrame:
    """``[[package]]`` blocks: the name, then the first version."""
    rows = _lines(_named(files, "poetry.lock"))
    name = F.regexp_extract("text", r"^name\s*=\s*\"([^\"]+)\"", 1)
    out = _blocks(rows, name, F.regexp_extract("text", r"^version\s*=\s*\"([^\"]+)\"", 1))
    return _packages(out.withColumn("name", python_name(F.col("name"))), "PyPI")


def requirements(files: DataFrame) -> DataFrame:
    """Exact pins only; comments, markers and extras are dropped."""
    shape = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*==\s*([^\s;#,*]+)\s*(?:;.*|\s#.*)?$"
    rows = _lines(_named(files, "requirements.txt"))
    rows = rows.select("lock_rel", python_name(F.regexp_extract("text", shape, 1)).alias("name"), F.regexp_extract("text", shape, 2).alias("version"), "line")
    return _packages(rows, "PyPI")


def packages(files: DataFrame) -> DataFrame:
    """Packages of all lock files, each (file, name, version, ecosystem) once at its lowest line."""
    out = npm(files)
    for read in (yarn, pnpm, composer, poetry, requirements):
        out = out.union(read(files))
    return out.groupBy("lock_rel", "name", "version", "ecosystem").agg(F.min("line").alias("line")).select("lock_rel", "name", "version", "line", "ecosystem")
