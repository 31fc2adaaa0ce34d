"""Pairs of alike functions: building, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalar import jaccard, shingles

LOCAL = r"\b(?:const|let|var)\s+([A-Za-z_]\w*)"
THRESHOLDS = [round(0.30 + 0.05 * k, 2) for k in range(14)]


def pair_key() -> Column:
    return F.concat_ws("|", F.least("a_id", "b_id"), F.greatest("a_id", "b_id"))


def is_duplicate(threshold: Column | float, gated: bool = False) -> Column:
    """Equal structure, or alike enough and, when asked for, of a fitting signature."""
    alike = F.coalesce(F.col("jaccard") >= threshold, F.lit(False))
    if gated:
        alike = alike & F.coalesce("sig_gate", F.lit(False))
    return F.coalesce("structural_match", F.lit(False)) | alike


def bucket() -> Column:
    return F.when(F.coalesce("structural_match", F.lit(False)), "structural").when(F.col("jaccard") >= 0.6, "high").when(F.col("jaccard") >= 0.3, "low").otherwise("below")


def signature_similarity(a: str, b: str) -> Column:
    """0.6 callees, 0.2 parameters, 0.1 returned value, 0.1 asynchrony; an unknown value equals nothing."""
    same = lambda c, w: F.when(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), w).otherwise(0.0)
    callees = [F.coalesce(F.col(f"{x}.callees"), F.array().cast("array<string>")) for x in (a, b)]
    return 0.6 * jaccard(*map(F.array_distinct, callees)) + same("param_count", 0.2) + same("returns_value", 0.1) + same("is_async", 0.1)


def not_nested(pairs: DataFrame) -> DataFrame:
    """Pairs (a_file, a_start_line, a_end_line, b_...) neither of which begins inside the other; unknown places are not nested."""
    inside = lambda x, y: F.col(f"{x}_start_line").between(F.col(f"{y}_start_line"), F.col(f"{y}_end_line"))
    nested = (F.col("a_file") == F.col("b_file")) & (inside("a", "b") | inside("b", "a"))
    return pairs.filter(~F.coalesce(nested, F.lit(False)))


def structural_classes(functions: DataFrame, least_tokens: int) -> DataFrame:
    """(id, shash, members) of functions that share their structure with another.

    Members of a class are one row each; a class of a million members makes no pairs.
    """
    long = functions.filter((F.size("toks") >= least_tokens) & F.col("shash").isNotNull()).select("id", "shash").distinct()
    sizes = long.groupBy("shash").agg(F.count("*").alias("members")).filter("members > 1")
    return long.join(sizes, "shash").select("id", "shash", "members")


def sweep(pairs: DataFrame, truth: Column, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, predicted, hits, actual, precision, recall) at each threshold; of nothing predicted precision is 0.

    The pairs are read once: each threshold is a pair of conditional counts.
    """
    counts = []
    for k, t in enumerate(thresholds):
        counts += [F.count_if(is_duplicate(t)).alias(f"p{k}"), F.count_if(is_duplicate(t) & truth).alias(f"h{k}")]
    one = pairs.agg(*counts, F.count_if(truth).alias("actual"))
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{k}").alias("predicted"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(thresholds)]))
    out = one.select(rows.alias("r"), "actual").select("r.*", "actual")
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return out.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "actual"))


def chosen(swept: DataFrame, recall: float) -> DataFrame:
    """The highest threshold that keeps a recall."""
    return swept.filter(F.col("recall") >= recall).agg(F.max("threshold").alias("threshold"), F.max_by("precision", "threshold").alias("precision"))


def weighted_precision(labelled: DataFrame, population: DataFrame) -> DataFrame:
    """Precision per stratum weighted by its population; strata without labels leave both sides."""
    each = labelled.groupBy("stratum").agg(F.avg(F.col("hit").cast("double")).alias("p"))
    rows = each.join(population.groupBy("stratum").agg(F.count("*").alias("n")), "stratum")
    return rows.agg(F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("precision"), F.count("*").alias("strata"))


def planted(functions: DataFrame) -> DataFrame:
    """(id, kind, source, planted): each function with four edited copies of itself.

    rename: its first local name everywhere; insert: a statement after the first
    line; literals: every number and quoted text; combined: all of them. A kind
    that changes nothing in a function, and a null source, make no row.
    """
    rows = functions.select("id", "source").dropna().distinct()
    name = F.regexp_extract("source", LOCAL, 1)
    edits = {
        "rename": lambda c: F.when(name != "", F.regexp_replace(c, F.concat(F.lit(r"\b"), name, F.lit(r"\b")), F.concat(name, F.lit("Planted")))).otherwise(c),
        "insert": lambda c: F.regexp_replace(c, r"^([^\n]*\n)", "$1  plantedCall(plantedValue, 1);\n"),
        "literals": lambda c: F.regexp_replace(F.regexp_replace(c, r"\b[0-9]+\b", "41"), r"'[^'\n]*'", "'planted'"),
    }
    edits["combined"] = lambda c: edits["insert"](edits["literals"](edits["rename"](c)))
    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e(F.col("source")).alias("planted")) for k, e in edits.items()]))
    return rows.withColumn("copy", copies).select("id", "copy.kind", "source", "copy.planted").filter("planted <> source")


def recall_by_kind(copies: DataFrame, width: int, threshold: float) -> DataFrame:
    """(kind, n, recall): the share of planted copies whose word runs are as alike as the threshold asks."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1)
    # Columns of their own: inside a lambda an expression is worked out again for every element.
    rows = copies.select("kind", words(F.col("source")).alias("a"), words(F.col("planted")).alias("b"))
    rows = rows.select("kind", shingles(F.col("a"), width).alias("a"), shingles(F.col("b"), width).alias("b"))
    alike = jaccard(F.col("a"), F.col("b"))
    hit = F.when(alike >= threshold, 1.0).otherwise(0.0)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("recall"))
