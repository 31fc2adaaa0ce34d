"""Scalar expressions shared by operators; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"

# The declared order of severities and confidences, which is no alphabetical one.
SEVERITIES = ("high", "medium", "low")
CONFIDENCES = ("high", "medium")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position in a declared order; unknown and null values come last."""
    return F.coalesce(*[F.when(value == v, F.lit(k)) for k, v in enumerate(order)], F.lit(len(order)))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def finding_id(rule: Column, rel: Column, anchor: Column) -> Column:
    """The first 16 hex digits of the hash of rule, path and trimmed anchor."""
    return F.substring(F.sha2(F.concat_ws(SEP, rule, rel, trimmed(anchor)), 256), 1, 16)


def lines(text: Column) -> Column:
    """Lines without their ends; a last line feed makes no line of its own."""
    return F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")


def identifier_words(name: Column) -> Column:
    """Lower-case words of camel, Pascal, snake and kebab case; acronyms and digits stay whole."""
    cut = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(cut, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


# Words of a phrase that say nothing of what is looked for.
STOP_WORDS = ("a", "an", "the", "to", "for", "of", "in", "on", "that", "is", "with", "and", "or", "function", "helper", "method")


def telling_words(phrase: Column) -> Column:
    """Distinct words of a phrase or identifier without those that say nothing."""
    return F.filter(F.array_distinct(identifier_words(phrase)), lambda w: ~w.isin(*STOP_WORDS))


def shannon(text: Column) -> Column:
    """Bits per character of a text; an empty one has none."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(each, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def masked(value: Column) -> Column:
    """The first four characters and the length."""
    return F.concat(F.left(value, F.lit(4)), F.lit("...("), F.length(value).cast("string"), F.lit(" chars)"))


def token_payload(token: Column) -> Column:
    """The payload of a signed web token as JSON text, or null."""
    middle = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(middle, (F.ceil(F.length(middle) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def python_name(name: Column) -> Column:
    """A Python package's name in lower case, runs of separators as one hyphen."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def without_ending(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def shingles(tokens: Column, width: int) -> Column:
    """Distinct joined runs of ``width`` tokens; a shorter list is one shingle, an empty one none."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(width)), SEP))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression. A star crosses slashes, as in the default of common glob libraries."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
            continue
        if c == "*":
            k += len(re.match(r"\*+", glob[k:]).group())
            out.append(".*")
            continue
        if c == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in glob[k + 1 : end].split(",")) + ")")
            k = end + 1
            continue
        if c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            out.append(glob[k : end + 1].replace("[!", "[^"))
            k = end + 1
            continue
        out.append("." if c == "?" else re.escape(c))
        k += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of a few globs; none of no globs."""
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)
