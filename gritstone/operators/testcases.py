"""Test cases of test files: name, place, whether skipped, and how many assertions each makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalar import lines

# Callees that start a case, the properties they may carry, and the name of a case without a literal one.
CALLEES = ("it", "test", "xit", "xtest", "fit", "ftest")
PROPERTIES = ("skip", "only", "todo", "failing", "concurrent")
UNNAMED = "<unnamed>"

START = rf"^\s*({'|'.join(CALLEES)})(?:\.({'|'.join(PROPERTIES)}))?\(\s*(?:'([^']*)'|\"([^\"]*)\"|`([^`]*)`)?"
ASSERTION = r"\b(?:expect|assert(?:\.\w+)?)\("


def cases(files: DataFrame) -> DataFrame:
    """(rel, name, line, end_line, skipped, assertions) of the cases in files (rel, source).

    A case begins on its line and reaches to the line before the next one; nested
    suites do not part it. Cases are found inside the row, so nothing is shuffled.
    A null source has none.
    """
    rows = files.select("rel", lines(F.col("source")).alias("lines"))
    numbered = lambda flag: F.array_compact(F.transform("lines", lambda t, i: F.when(flag(t), (i + 1).cast("long"))))
    rows = rows.select("rel", "lines", numbered(lambda t: t.rlike(START)).alias("starts"), numbered(lambda t: t.rlike(ASSERTION)).alias("asserts")).filter("size(starts) > 0")
    ends = F.concat(F.transform(F.slice("starts", F.lit(2), F.size("starts")), lambda n: n - 1), F.array(F.size("lines").cast("long")))
    made = F.zip_with(
        "starts", ends, lambda a, b: F.struct(a.alias("line"), b.alias("end_line"), F.element_at("lines", a.cast("int")).alias("text"), F.size(F.filter("asserts", lambda n: n.between(a, b))).cast("long").alias("assertions"))
    )
    out = rows.select("rel", F.explode(made).alias("c")).select("rel", "c.*")
    got = lambda k: F.nullif(F.regexp_extract("text", START, k), F.lit(""))
    name = F.coalesce(got(3), got(4), got(5), F.lit(UNNAMED))
    skipped = F.regexp_extract("text", START, 1).startswith("x") | F.regexp_extract("text", START, 2).isin("skip", "todo")
    return out.select("rel", name.alias("name"), "line", "end_line", skipped.alias("skipped"), "assertions")


def without_assertion(found: DataFrame) -> DataFrame:
    """Cases that run and assert nothing."""
    return found.filter("not skipped and assertions = 0")


def skipped_names(found: DataFrame) -> DataFrame:
    """(rel, name) of the cases a run leaves out."""
    return found.filter("skipped").select("rel", "name").distinct()


def is_test_file(rel: Column) -> Column:
    """By naming convention: ``*.test.*``, ``*.spec.*`` or under ``__tests__``."""
    return rel.rlike(r"\.(?:test|spec)\.[^/]*$|(?:^|/)__tests__/")
