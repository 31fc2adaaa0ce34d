"""Reading level of documents.

Prose is taken out of a document's markup; sentences, words, letters and syllables
by hyphenation-style rules go into six classic grade formulas, whose median is the
document's grade. Cut points between levels are fitted to labels by one histogram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed, spread

BINS_PER_GRADE = 10
GRADES = 60
LEVELS = 5
HARD = 4
UNLABELLED = (6.0, 9.0, 13.0, 16.0)  # school grades at which levels 2 to 5 begin where no label says otherwise
MIN_WORDS = 3

_FENCE = re.compile(r"^(?P<f>`{3,}|~{3,})[^\n]*\n(?:[\s\S]*?^(?P=f)[ \t]*$|[\s\S]*\Z)", re.M)
_LIST = re.compile(r"(?:[-*+•]|\d{1,3}[.)]|\[[ xX]\])\s")
_TRACE = re.compile(
    r"at \S+ ?\(|at \S+:\d+|File \"[^\"]*\", line \d+|Traceback \(|Caused by:|\.\.\. \d+ more|(?:[A-Za-z_][\w.]*(?:Error|Exception|Warning))(?::|$)|#\d+ |\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|(?:ERROR|WARN|INFO|DEBUG)\b|>>> |\$ "
)
_COMMIT_HEAD = re.compile(r"(?:feat|fix|chore|docs|refactor|test|perf|build|ci|style|revert)(?:\([^)]*\))?!?: ")
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)|https?://\S+")
_SENTENCE = re.compile(r"[.!?…]+(?=[\s\"')\]]|$)|\n{2,}")
_WORD = re.compile(r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
_LETTER = re.compile(r"[^\W\d_]")
# The commonest function words of English.
_ENGLISH = frozenset(
    "the a an and or but if then of to in on at by for from with without into is are was were be been being it its this that these those there each every which who whose when while as because so than not no do does did has have had can could may might must should would will we you they he she i our your their my how what where after before since although unless whether both neither nor any some all more most such other only also still first".split()
)
# The commonest function words of other languages of the corpus.
_OTHER = frozenset(
    "der die das und ist nicht ein eine einen mit für auf den dem des von zu im wird werden auch wenn le la les des et est un une pas pour dans que qui sur avec du au el los las y es no una por para con que se del al como".split()
) - _ENGLISH


def prose(text: str) -> list[str]:
    """Paragraphs of running text, without fenced and indented code, headings, lists, tables and traces."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    text = _FENCE.sub("\n\n", text)
    out: list[str] = []
    current: list[str] = []
    listed = False
    lines = text.split("\n")
    for k, line in enumerate(lines):
        bare = line.strip()
        following = lines[k + 1].strip() if k + 1 < len(lines) else ""
        heading = bare.startswith("#") and not bare.startswith("#!") or len(following) > 2 and bare and not set(following) - set("=-") and len(set(following)) == 1
        rule = bool(bare) and not set(bare) - set("=-_*~ ")
        table = bare.startswith("|") or bare.count("|") > 1
        item = bool(_LIST.match(bare))
        indented = line.startswith(("    ", "\t"))
        if not bare or heading or rule or table or item or indented or _TRACE.match(bare) or _COMMIT_HEAD.match(bare):
            if current:
                out.append(" ".join(current))
                current = []
            listed = item or (listed and bool(bare))
            continue
        if listed and line[:1] in " \t":
            continue
        listed = False
        if bare.startswith(">"):
            bare = bare.lstrip("> ")
        current.append(bare)
    if current:
        out.append(" ".join(current))
    return out


@cache
def _rules() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    silent = re.compile(r"(?:[^laeiouy]es|[^tdaeiouy]ed|[^laeiouy]e|que|gue)$")
    split = re.compile(r"ia(?!n[cs]|l|r[dt])|io(?!n|u)|eo(?!u)|ua(?!l|r[dt])|uo|ea(?=te|ti|to)|ie(?=t|nc)|ii|[aeiouy]ing$|(?<=[rvn])ia(?=l)|ism$|[^aeiouy]led$")
    return silent, split, re.compile(r"[aeiouy]+")


@cache
def syllables(word: str) -> int:
    """Syllables of a lower-case word: vowel groups, less silent endings, more split groups."""
    silent, split, groups = _rules()
    n = len(groups.findall(word))
    if silent.search(word) and n > 1:
        n -= 1
    return max(1, n + len(split.findall(word)))


def counts(paragraphs: list[str]) -> tuple[int, int, int, int, int, int, int]:
    """(sentences, words, letters, syllables, words of three and more, English words, foreign words)."""
    sentences = words = letters = syl = poly = english = foreign = 0
    for p in paragraphs:
        p = _LINK.sub(lambda m: m.group(1) or " ", _CODE_SPAN.sub(" it ", p))
        for s in _SENTENCE.split(p):
            found = _WORD.findall(s)
            if not found:
                continue
            sentences += 1
            for w in found:
                low = w.lower()
                n = sum(map(syllables, re.split(r"['’-]", low))) if not low.isalpha() else syllables(low)
                words += 1
                letters += len(w)
                syl += n
                poly += n >= 3
                english += low in _ENGLISH
                foreign += low in _OTHER
    return sentences, words, letters, syl, poly, english, foreign


def grade(text: str | None) -> float | None:
    """The median of six grade formulas; None for a text without English prose."""
    if not text:
        return None
    found = prose(text)
    sentences, words, letters, syl, poly, english, foreign = counts(found)
    if words < MIN_WORDS:
        return None
    joined = " ".join(found)
    script = len(_LETTER.findall(joined))
    # Of running English every fourth word or so is a function word; other scripts have few Latin words.
    if english * 8 < words or foreign * 2 > english or letters * 2 < script - sum(map(len, _CODE_SPAN.findall(joined))):
        return None
    w, s = words, sentences
    formulas = [
        0.39 * w / s + 11.8 * syl / w - 15.59,  # Flesch-Kincaid
        0.4 * (w / s + 100 * poly / w),  # Gunning fog
        1.043 * (30 * poly / s) ** 0.5 + 3.1291,  # SMOG
        0.0588 * (100 * letters / w) - 0.296 * (100 * s / w) - 15.8,  # Coleman-Liau
        4.71 * letters / w + 0.5 * w / s - 21.43,  # automated readability
        (206.835 - (206.835 - 1.015 * w / s - 84.6 * syl / w)) / 10,  # Flesch ease, turned into tenths
    ]
    return float(median(formulas))


def grades(documents: DataFrame) -> DataFrame:
    """(doc_id, grade) of every document with English prose, whatever its stored language.

    Null, empty and proseless texts have no row. Of several texts of one id the
    highest grade counts. Whole texts are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [grade(t) for t in batch.column(1).to_pylist()]
            values = pa.array(out, pa.float64())
            keep = values.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), values.filter(keep)], ["doc_id", "grade"])

    rows = spread(documents.select("doc_id", "text").dropna()).mapInArrow(run, "doc_id long, grade double")
    return rows.groupBy("doc_id").agg(F.max("grade").alias("grade"))


def cut_points(graded: DataFrame, labels: DataFrame) -> list[float]:
    """Grades at which levels 2 to 5 begin, chosen for the fewest labels on the wrong side.

    All labels count, each by its own level; raters who disagree weigh against each
    other. What reaches the driver is a histogram of fixed size. Without any
    label the levels begin at fixed school grades.
    """
    at = F.least(F.greatest(F.floor(F.col("grade") * BINS_PER_GRADE), F.lit(0)), F.lit(GRADES * BINS_PER_GRADE - 1)).cast("int")
    rows = graded.join(labels.filter(F.col("level").between(1, LEVELS)).select("doc_id", "level"), "doc_id")
    seen: dict[tuple[int, int], int] = {(r["at"], r["level"]): r["n"] for r in rows.groupBy(at.alias("at"), "level").agg(F.count("*").alias("n")).collect()}
    if not seen:
        return list(UNLABELLED)
    points, floor = [], 0
    for level in range(2, LEVELS + 1):
        low = [0] * (GRADES * BINS_PER_GRADE)
        high = low.copy()
        for (k, y), n in seen.items():
            (high if y >= level else low)[k] += n
        # Errors of a cut before bin k: lower levels at and after it, higher ones before it.
        errors = sum(low[floor:]) + sum(high[:floor])
        options = [(errors, floor)]
        for k in range(floor, GRADES * BINS_PER_GRADE):
            errors += high[k] - low[k]
            options.append((errors, k + 1))
        least = min(e for e, _ in options)
        best = [k for e, k in options if e == least]
        floor = best[len(best) // 2]
        points.append(floor / BINS_PER_GRADE)
    return points


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, grade, level) of every document with English prose."""
    graded = checkpointed(grades(documents))
    points = cut_points(graded, labels.distinct())
    level = sum((F.when(F.col("grade") >= p, 1).otherwise(0) for p in points), F.lit(1))
    return graded.select("doc_id", F.round("grade", 6).alias("grade"), level.cast("int").alias("level"))


def hard_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return reading_levels(documents, labels).filter(F.col("level") >= HARD).select("doc_id")
