"""Tests of single values that may be credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritstone.functions.scalar import shannon

# What a generated value has at least, and bits below which a value is filler.
LEAST_LENGTH, LEAST_CLASSES, LEAST_BITS, FILLER_BITS, RUN = 20, 3, 3.5, 2.0, 6
STAND_IN = r"(?i)(?:test|fake|dummy|mock|demo)"
PATH = r"^[A-Za-z0-9._/\\@-]*[/\\][A-Za-z0-9._/\\@-]*$"


def climbs(value: Column) -> Column:
    """Whether six characters in a row step one code point each, all up or all down."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), F.ascii)
    steps = F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.size(codes), F.lit(1))), lambda a, b: F.when(b - a == 1, "+").when(b - a == -1, "-").otherwise("."))
    walk = F.array_join(steps, "")
    return walk.contains("+" * (RUN - 1)) | walk.contains("-" * (RUN - 1))


def repeats(value: Column) -> Column:
    """Whether a value is one group of characters repeated: it is found in its own double, shifted."""
    n = F.length(value)
    return F.position(value, F.substring(F.concat(value, value), F.lit(2), 2 * n - 2)) > 0


def looks_generated(value: Column) -> Column:
    """Whether a value looks generated rather than written; null looks like nothing."""
    classes = sum((F.when(value.rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    written = value.rlike(r"\s") | value.contains("://") | value.startswith("www.") | value.rlike(PATH) | repeats(value) | climbs(value) | value.rlike(STAND_IN)
    return F.coalesce((F.length(value) >= LEAST_LENGTH) & ~written & (classes >= LEAST_CLASSES) & (shannon(value) >= LEAST_BITS), F.lit(False))


def is_filler(value: Column) -> Column:
    """Whether a value has too little surprise to stand for anything."""
    return shannon(value) < FILLER_BITS


def decodes_to_a_pair(value: Column) -> Column:
    """Whether the payload of a basic header is a printable user, a colon and a printable password."""
    text = F.try_to_binary(value, F.lit("base64")).cast("string")
    return F.coalesce(text.rlike(r"^[ -9;-~]+:[ -~]+$"), F.lit(False))
