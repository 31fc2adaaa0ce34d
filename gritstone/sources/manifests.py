"""Package manifests: names, workspaces and the files they start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.operators.imports import find_modules, joined_inside

SCRIPT_FILE = r"(?:^|[\s'\"=])(?:\./)?([\w@][\w@./-]*\.[mc]?[jt]sx?)(?=[\s'\";&|]|$)"


def _several(value: Column, of: str) -> Column:
    """A JSON value that may be one text, a list or a map of texts: its texts."""
    text = F.trim(value)
    none = F.array().cast("array<string>")
    return (
        F.when(text.startswith("{"), F.map_values(F.from_json(text, "map<string,string>")))
        .when(text.startswith("["), F.from_json(text, "array<string>"))
        .when(text.isNotNull() & F.lit(of == "text"), F.array(text))
        .otherwise(none)
    )


def manifests(files: DataFrame) -> DataFrame:
    """(rel, dir, name, main, workspaces, entries) of the package.json among files (rel, text).

    ``entries`` are the files, from the root, that main, module and bin name and that
    scripts run. Text that is no JSON object gives a row without any of them.
    """
    rows = files.filter(F.col("rel").rlike(r"(?:^|/)package\.json$") & F.col("text").isNotNull())
    folder = F.regexp_replace("rel", r"[^/]*$", "")
    got = lambda path: F.get_json_object("text", path)
    scripts = F.map_values(F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>"))
    run = F.flatten(F.transform(F.coalesce(scripts, F.array().cast("array<string>")), lambda s: F.regexp_extract_all(s, F.lit(SCRIPT_FILE), 1)))
    spaces = F.coalesce(F.from_json(F.get_json_object("text", "$.workspaces.packages"), "array<string>"), _several(got("$.workspaces"), "list"))
    rows = rows.select("rel", folder.alias("folder"), got("$.name").alias("name"), got("$.main").alias("main"), spaces.alias("workspaces"), F.concat(F.array_compact(F.array(got("$.main"), got("$.module"))), _several(got("$.bin"), "text"), run).alias("named"))
    entries = F.array_compact(F.array_distinct(F.transform("named", lambda p: joined_inside(F.col("folder"), p))))
    return rows.select("rel", F.regexp_replace("folder", "/$", "").alias("dir"), "name", "main", "workspaces", entries.alias("entries"))


def workspace_packages(found: DataFrame) -> DataFrame:
    """(name, dir, main) of the packages inside a workspace: those whose folder a pattern of a manifest above covers.

    Patterns are folders or end in one star for the folders inside, as ``packages/*``.
    """
    patterns = found.select(F.col("dir").alias("root"), F.explode("workspaces").alias("pattern"))
    base = F.when(F.col("root") == "", F.regexp_replace("pattern", r"^\./|/$", "")).otherwise(F.concat("root", F.lit("/"), F.regexp_replace("pattern", r"^\./|/$", "")))
    wide = base.endswith("/*")
    places = patterns.select(F.regexp_replace(base, r"/\*$", "").alias("place"), wide.alias("wide")).distinct()
    inner = found.filter("name is not null").withColumn("above", F.regexp_replace("dir", "/?[^/]*$", ""))
    exact = inner.join(places.filter("not wide").select(F.col("place").alias("dir")).distinct(), "dir", "left_semi")
    below = inner.join(places.filter("wide").select(F.col("place").alias("above")).distinct(), "above", "left_semi")
    return exact.select("name", "dir", "main").union(below.select("name", "dir", "main")).distinct()


def entry_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """(rel) of the files that manifests start from, each looked up as an import would be."""
    wanted = found.select(F.explode("entries").alias("wanted")).distinct()
    return find_modules(wanted, files).filter("target is not null").select(F.col("target").alias("rel")).distinct()
