"""The import graph: resolution, dead code, boundaries and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalar import matches_any
from gritstone.operators.keyed import answered_by
from gritstone.operators.orphans import joined_path, normal_path
from gritstone.session import checkpointed


# Endings an import may leave out in the order they are tried, and output endings with the source each may stand for.
SOURCE_ENDINGS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
OUTPUT_TO_SOURCE = (("js", "ts"), ("js", "tsx"), ("jsx", "tsx"), ("mjs", "mts"), ("cjs", "cts"))
DECLARATION = r"\.d\.[mc]?ts$"


def one_per_edge(edges: DataFrame) -> DataFrame:
    """The first delivery of each edge, with paths in one spelling; of equal times the smallest row."""
    order = ["loaded_at", "seen_at", *[c for c in edges.columns if c not in ("edge_id", "loaded_at", "seen_at")]]
    first = F.min(F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(c) for c in order]))
    kept = edges.filter("edge_id is not null").groupBy("edge_id").agg(first.alias("v"))
    kept = kept.select("edge_id", *[F.col(f"v.{c}.value").alias(c) for c in edges.columns if c != "edge_id"])
    return kept.withColumns({c: normal_path(F.col(c)) for c in ("from_rel", "to_rel")})


def current_files(files: DataFrame) -> DataFrame:
    """The last indexing of each path; of equal times the greatest row."""
    return files.filter("rel is not null").groupBy("rel").agg(F.max(F.struct("indexed_at", "content_hash", "language", "parse_status", "size", "mtime", "repo")).alias("v")).select("rel", "v.*")


def joined_inside(base: Column, relative: Column) -> Column:
    """``relative`` joined to the folder of ``base``; null where it steps above the root."""
    path = joined_path(base, relative)
    return F.when(~path.rlike(r"^\.\.(/|$)"), path)


def answered(path: Column) -> Column:
    """What a file at ``path`` can be imported as: an array of (wanted, rank), the lower rank tried first.

    The path itself, then a source behind an output ending, then the path with an
    ending added, then an index file of a folder.
    """
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    folder = F.when(stem.rlike("/index$"), F.regexp_replace(stem, "/index$", ""))
    place = F.array_position(F.array(*map(F.lit, SOURCE_ENDINGS)), ending).cast("int")
    pair = lambda wanted, rank: F.when(wanted.isNotNull(), F.struct(wanted.alias("wanted"), rank.cast("int").alias("rank")))
    ways = [pair(path, F.lit(0))]
    ways += [pair(F.when(ending == source, F.concat(stem, F.lit(f".{output}"))), F.lit(k + 1)) for k, (output, source) in enumerate(OUTPUT_TO_SOURCE)]
    ways += [pair(F.when(place > 0, stem), place + 10), pair(F.when(place > 0, folder), place + 20)]
    return F.array_compact(F.array(*ways))


def _answers(files: DataFrame) -> DataFrame:
    """(wanted, target): the file that each importable path leads to; declarations of types are no modules."""
    rels = files.select("rel").filter(~F.col("rel").rlike(DECLARATION)).distinct()
    ways = rels.select("rel", F.explode(answered(F.col("rel"))).alias("w"))
    return ways.groupBy("w.wanted").agg(F.min_by("rel", "w.rank").alias("target"))


def find_modules(wanted: DataFrame, files: DataFrame, *keys: str) -> DataFrame:
    """``wanted`` (keys, wanted) with the target each path leads to.

    Paths are looked up once each; a path that a third of all edges want is spread.
    """
    asked = checkpointed(wanted.select(*keys, "wanted"))
    found = asked.select("wanted").filter("wanted is not null").distinct().join(_answers(files), "wanted")
    return answered_by(asked, found, "wanted").select(*keys, "target")


def resolved(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(edge_id, target): the first candidate of a relative specifier that is indexed.

    A file lists the few specifiers that lead to it, ranked in the order candidates
    are tried, so edges are joined once and never multiplied by their candidates.
    Edges that lead nowhere or above the root have a null target.
    """
    near = edges.filter(F.col("specifier").startswith(".") & F.col("from_rel").isNotNull())
    near = near.select("edge_id", joined_inside(F.col("from_rel"), F.col("specifier")).alias("wanted"))
    return find_modules(near, files, "edge_id")


def resolved_by_alias(edges: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """(edge_id, target) of edges whose specifier an alias (pattern with at most one star, targets) covers.

    Patterns are tried by the length of the text before their star, longest first,
    the targets of each in order, each as in ``resolved``. None indexed gives a
    null target. Relative and absolute specifiers are no aliases. Aliases come from
    the configuration, so an edge has a few literal candidates.
    """
    spec = F.col("specifier")
    choices = []
    for pattern, targets in sorted(aliases, key=lambda a: -len(a[0].partition("*")[0])):
        head, star, tail = pattern.partition("*")
        fits = spec.startswith(head) & spec.endswith(tail) & (F.length(spec) >= len(head) + len(tail)) if star else spec == pattern
        held = F.substring(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
        put = lambda t: F.concat(F.lit(t.partition("*")[0]), held, F.lit(t.partition("*")[2])) if "*" in t else F.lit(t)  # noqa: B023, E731
        choices.append(F.when(fits, F.array(*map(put, targets))).otherwise(F.array().cast("array<string>")))
    if not choices:
        return edges.select("edge_id", F.lit(None).cast("string").alias("target")).limit(0)
    tried = edges.filter(~spec.rlike("^[./]")).select("edge_id", F.posexplode(F.concat(*choices)).alias("pos", "path"))
    tried = tried.select("edge_id", "pos", joined_inside(F.lit(""), F.col("path")).alias("wanted"))
    found = find_modules(tried, files, "edge_id", "pos")
    return found.groupBy("edge_id").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("pos"))).alias("target"))


def resolved_by_package(edges: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(edge_id, target) of edges whose specifier is a workspace package (name, dir, main) or a path inside one.

    The package itself leads to its main file, index where it names none. A name is
    the first part of a specifier, or the first two behind an at sign. Of packages
    of one name the first by folder counts.
    """
    name = F.regexp_extract("specifier", r"^(@[^/]+/[^/]+|[^@./][^/]*)", 1)
    rest = F.regexp_replace("specifier", r"^(@[^/]+/[^/]+|[^@./][^/]*)/?", "")
    known = packages.filter("name is not null and dir is not null").groupBy("name").agg(F.min(F.struct("dir", "main")).alias("p"))
    near = edges.filter("specifier is not null").select("edge_id", name.alias("name"), rest.alias("rest")).filter("name <> ''").join(known, "name")
    inside = F.when(F.col("rest") == "", F.coalesce("p.main", F.lit("index"))).otherwise(F.col("rest"))
    near = near.select("edge_id", joined_inside(F.concat("p.dir", F.lit("/")), inside).alias("wanted"))
    return find_modules(near, files, "edge_id")


def dead_files(files: DataFrame, edges: DataFrame, entry_globs: list[str], entries: DataFrame | None = None) -> DataFrame:
    """(rel) of files that nothing imports and that are no entry points, by pattern or named in ``entries`` (rel).

    Files importing each other count as imported.
    """
    imported = edges.filter("to_rel is not null").select(F.col("to_rel").alias("rel"))
    if entries is not None:
        imported = imported.union(entries.select("rel"))
    return files.select("rel").distinct().filter(~matches_any(F.col("rel"), entry_globs)).join(imported.distinct(), "rel", "left_anti")


def dead_exports(exports: DataFrame, edges: DataFrame) -> DataFrame:
    """(rel, name) exported by a file that has importers, none of which takes the name or the whole module."""
    used = edges.filter("to_rel is not null").select("to_rel", "name").distinct()
    importers = used.select(F.col("to_rel").alias("rel")).distinct()
    whole = used.filter("name = '*'").select(F.col("to_rel").alias("rel"))
    by_name = used.select(F.col("to_rel").alias("rel"), "name")
    return exports.join(importers, "rel", "left_semi").join(whole, "rel", "left_anti").join(by_name, ["rel", "name"], "left_anti")


def boundary_violations(edges: DataFrame, boundaries: list[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """(from_rel, line, to_rel, label) of edges from a zone to a place it must not import.

    A boundary (label, zone, forbidden, allowed) names what is forbidden or, where
    that is empty, all that is allowed besides the zone itself. Boundaries come from
    the configuration, so each becomes a literal predicate and the edges are read once.
    """
    to = F.col("to_rel")
    crossed = lambda zone, forbid, allow: matches_any(to, forbid) if forbid else ~matches_any(to, [*allow, zone])
    labels = F.array_compact(F.array(*[F.when(matches_any(F.col("from_rel"), [zone]) & crossed(zone, forbid, allow), F.lit(label)) for label, zone, forbid, allow in boundaries]))
    return edges.filter("to_rel is not null").select("from_rel", "line", "to_rel", F.explode(labels).alias("label")).distinct()


def neighbours(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """(rel): the scope and the files one import away, either way."""
    pairs = edges.filter("to_rel is not null").select("from_rel", "to_rel").distinct()
    out = pairs.join(scope.select(F.col("rel").alias("from_rel")), "from_rel", "left_semi").select(F.col("to_rel").alias("rel"))
    into = pairs.join(scope.select(F.col("rel").alias("to_rel")), "to_rel", "left_semi").select(F.col("from_rel").alias("rel"))
    return scope.select("rel").union(out).union(into).filter("rel is not null").distinct()


def without_departed(edges: DataFrame, present: DataFrame) -> DataFrame:
    """Edges of present files; those into files that went away lose their target and become unresolved."""
    kept = checkpointed(edges.join(present.select(F.col("rel").alias("from_rel")).distinct(), "from_rel", "left_semi"))
    here = present.select(F.col("rel").alias("to_rel"), F.lit(True).alias("here")).distinct()
    rows = answered_by(kept, here, "to_rel")
    gone = F.col("to_rel").isNotNull() & F.col("here").isNull()
    return rows.withColumn("resolution", F.when(gone, "unresolved").otherwise(F.col("resolution"))).withColumn("to_rel", F.when(~gone, F.col("to_rel"))).drop("here")
