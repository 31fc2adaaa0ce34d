"""Generated, minified, vendored and data files among source files.

Every file gets evidence for five labels from its text, its name, its size and the
share of its line pairs that other repositories hold too. Sum-product belief
propagation on the directory tree then combines it: directories carry a hidden label,
parents and children favour equal ones. A file without marks among foreign siblings
is read as they are, and a half mark (a licence without a version, a version of its
own) counts among foreign files but not in a hand-written part of the tree.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed, spread

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
HAND, GENERATED, MINIFIED, VENDORED, BLOB = range(5)

# How a directory of a label (row) holds files and directories of each label: a hand-written one
# has few others among its own, a foreign one is nearly all of a kind.
COMPATIBLE = [[0.96, 0.01, 0.01, 0.01, 0.01]] + [[0.1 if y == 0 else 0.86 if y == x else 0.04 / 3 for y in range(5)] for x in range(1, 5)]

# Log odds of what a file shows of itself. A mark that hand-written files practically never
# bear outweighs any folder. Half marks are borne by both: alone they say too little, so the tree
# decides. What no mark says is little too, so a file without any is read as its folder is.
STRONG, HALF, WEAK = 9.0, 3.2, 1.5
PLAIN = 2.1  # that a file without any mark is handwritten; three foreign siblings outweigh it, or two in a folder named for them
LARGE = 0.5  # that a file is no hand's work, for a size no hand writes
LARGE_BYTES = 65536
COMMON = 3  # repositories that hold a line pair before it counts as passed around
ROWS, CHARACTERS = 60, 1000  # a literal this large is data

# Names of directories and file-name parts, and what they hint at.
DIRECTORY_HINTS = {
    GENERATED: "generated __generated__ gen autogen chunks dist build".split(),
    VENDORED: "vendor third_party third-party thirdparty 3rdparty node_modules externals bower_components".split(),
}
NAME_HINTS = {GENERATED: re.compile(r"\.(?:gen|generated|pb|designer)\.[^.]+$"), MINIFIED: re.compile(r"[.-]min\.[^.]+$")}
CODE_ENDING = re.compile(r"\.(?:[mc]?[jt]s|[jt]sx|php|phtml|py)$")

_COMMENT_LINE = re.compile(r"[ \t]*(?://|#(?!!)|/\*|\*|<!--|\"\"\")")
_TOOL = re.compile(
    r"(?i)@generated\b|\bauto-?generated\b|\bautomatically generated\b|\bcode generated by\b.*\bdo not edit|\bgenerated (?:on|at) \S+ (?:with|by) |\bgenerated (?:by|from) \S+.*(?:do not (?:edit|modify)|overwritten)|\b(?:produced|emitted|written|created|compiled) by \S+ from \S+|\bedit the \w+ instead\b|\bmachine[- ]generated\b"
)
_TOOL_WORD = re.compile(r"[Gg]enerated|GENERATED| by .* from |instead")
_COMPILED = re.compile(
    r"Object\.defineProperty\(exports, ['\"]__esModule['\"]|^var __(?:awaiter|spread\w*|assign|extends|rest|decorate|importDefault|importStar|generator|createBinding|values|read)\b|^//[#@] sourceMappingURL=|\b__webpack_require__\b|^System\.register\(",
    re.M,
)
_MODULE = re.compile(r"^\s*(?:\d+|\"[^\"\n]+\"): *(?:function *)?\((?:\w+, *){0,2}\w+\) *(?:=>)? *\{", re.M)
# How a library wraps itself to be loaded by any page or module system, and a version of its own in a lone module.
_WRAPPER = re.compile(
    r";?\s*(?:!|\()\s*function\s*\(\s*(?:root|global|window|self)\b[^)]*\)|;?\(function \(\$\w*\) \{\s*\$\.(?:fn\.)?\w+ = |var [A-Za-z]\w* = \(function \(\w*\) \{[\s\S]*\bdefine\.amd\b|\(function webpackUniversalModuleDefinition\("
)
_OWN_VERSION = re.compile(r"^__version__ = [\"']", re.M)
_LICENCE = re.compile(r"(?i)\blicen[cs]ed?\b|\bspdx-license|\ball rights reserved\b.*\bcontributors\b")
_VERSION = re.compile(r"\bv?\d+\.\d+\.\d+\b")
_STRINGS = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`")
_WORD = re.compile(r"[A-Za-z0-9_$]+")
_NUMBER = re.compile(r"\d+")
_LEADING = re.compile(r"﻿?\s*(?:(?:#![^\n]*\n|<\?php|/\*[\s\S]*?\*/|//[^\n]*|#[^\n]*|\"\"\"[\s\S]*?\"\"\"|<!--[\s\S]*?-->)\s*)*")
_BODY_START = re.compile(
    r"\s*(?:<\?php\s+)?(?:['\"]use strict['\"];?\s*)?(?:(?:export|declare)\s+)*(?:default\s+|module\.exports\s*=\s*|exports\.\w+\s*=\s*|return\s+|(?:(?:const|let|var|final)\s+)?\$?\w+(?:\s*:\s*[\w$<>\[\], |{}:\"']{1,200}?)?\s*=\s*)"
)
_LITERAL_REST = re.compile(r"(?>[\s\[\]{}(),:;.+\-]|=>|0x[0-9a-fA-F]+|\d[\d_.eE]*|\b(?:true|false|null|None|True|False|undefined|array|as|const|[A-Za-z_]\w*(?=\s*:))\b|\b\w+(?=\s*:)|\?>)*+")
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|^[ \t]*(?://|#)[^\n]*|[ \t]//[^\n\"'`]*$", re.M)
_TRIPLE = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")


def is_blob(text: str) -> bool:
    """Nothing but one large literal, comments aside."""
    if len(text) <= CHARACTERS and text.count("\n") < ROWS:
        return False
    m = _BODY_START.match(text := _COMMENTS.sub("", text.removeprefix("﻿")).strip())
    if m is None:
        return False
    body = text[m.end() :].strip()
    if not body or body[0] not in "[{('\"`" and not body.startswith(("array(", "b'", 'b"')):
        return False
    if len(body.rstrip(";")) <= CHARACTERS and body.count("\n") + 1 < ROWS:
        return False
    rest = _STRINGS.sub(" ", _TRIPLE.sub(" ", body))
    return _LITERAL_REST.fullmatch(rest) is not None


def runs_on(lines: list[str]) -> bool:
    """Most lines have a few shapes, and a number climbs steadily from one to the next of a shape."""
    by: dict[str, list[str]] = {}
    for line in lines:
        if len(line) > 3:
            by.setdefault(_WORD.sub("w", line), []).append(line)
    total = sum(map(len, by.values()))
    if total < 8:
        return False
    top = sorted(by.values(), key=len, reverse=True)[:4]
    if sum(map(len, top)) < 0.7 * total or len(top[0]) < 4:
        return False
    for group in top:
        if len(group) < 4:
            continue
        rows = [_NUMBER.findall(x) for x in group]
        width = min(map(len, rows))
        for k in range(width):
            column = [int(r[k][:15]) for r in rows]
            steps = Counter(b - a for a, b in zip(column, column[1:]))
            step, n = steps.most_common(1)[0]
            if step > 0 and n >= 0.9 * (len(column) - 1):
                return True
    return False


def is_minified(lines: list[str]) -> bool:
    """Long lines of code without the blanks a hand leaves; strings do not count."""
    dense = plain = 0
    for line in lines:
        if len(line) > 160:
            code = _STRINGS.sub("s", line)
            marks = sum(code.count(c) for c in ";,(){}=")
            if len(code) > 140 and code.count(" ") * 9 < len(code) and marks * 7 > len(code) and code.count(";") + code.count(",") >= 6:
                dense += len(line)
                continue
        if not _COMMENT_LINE.match(line):
            plain += len(line)
    return dense > 2 * plain and dense > 0


def text_evidence(rel: str, text: str) -> tuple[list[float], list[int]]:
    """Log evidence for each label, and the hashes of all distinct line pairs of the text."""
    phi = [PLAIN, 0.0, 0.0, 0.0, 0.0]
    blob = is_blob(text)
    if not text.strip("﻿ \t\r\n"):
        return [STRONG, 0.0, 0.0, 0.0, 0.0], []
    lines = [s for x in text.split("\n") if (s := x.strip())]
    head = _LEADING.match(text).group()
    if any(_COMMENT_LINE.match(x) and _TOOL.search(x) for x in lines if _TOOL_WORD.search(x)):
        phi[GENERATED] += STRONG
    if _COMPILED.search(text) or len(_MODULE.findall(text)) >= 3 and "(" in lines[0]:
        phi[GENERATED] += STRONG
    elif not blob and runs_on([x for x in lines if not _COMMENT_LINE.match(x)]):
        phi[GENERATED] += STRONG
    if is_minified(lines):
        phi[MINIFIED] += STRONG
    if _LICENCE.search(head) and _VERSION.search(head) and "internal use only" not in head.lower():
        phi[VENDORED] += STRONG
    elif _WRAPPER.match(text, len(head)):
        phi[VENDORED] += STRONG
    elif _LICENCE.search(head) or rel.endswith(".py") and not rel.endswith(("__init__.py", "version.py", "setup.py")) and _OWN_VERSION.search(text):
        phi[VENDORED] += HALF
    if blob:
        phi[BLOB] += STRONG
    name = rel.rpartition("/")[2]
    for label, hint in NAME_HINTS.items():
        if hint.search(name):
            phi[label] += WEAK
    code = [x for x in lines if len(x) > 12 and not _COMMENT_LINE.match(x)]
    pairs = {xxhash.xxh64_intdigest(a + "\n" + b) >> 1 for a, b in zip(code, code[1:]) if len(a) + len(b) >= 50 and not a.startswith(("import ", "use ", "from "))}
    return phi, sorted(pairs)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rels, phis, hashes = [], [], []
        for rel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if CODE_ENDING.search(rel):
                phi, pairs = text_evidence(rel, text)
                rels.append(rel)
                phis.append(phi)
                hashes.append(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(phis, pa.list_(pa.float64())), pa.array(hashes, pa.list_(pa.int64()))], ["rel", "phi", "pairs"])


def _sizes(files: DataFrame) -> DataFrame:
    """(rel, bytes): the size at the last indexing that knows one; 0 and null are unknown."""
    known = files.filter("rel is not null and size > 0")
    return known.groupBy("rel").agg(F.max_by("size", F.struct("indexed_at", "size")).alias("bytes"))


def evidence(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, f0..f4): log evidence of every source file, one row per path.

    A path with several texts takes the sum of their evidence; equal rows count
    once. Each text is compared by all its line pairs. The repositories of a pair are
    kept in two bitmaps, which partial aggregation keeps to one row per pair and task.
    Pairs that COMMON repositories hold are passed around.
    """
    rows = spread(parsed.select("rel", "source").dropna()).mapInArrow(_evidence, "rel string, phi array<double>, pairs array<long>")
    rows = checkpointed(rows.distinct().withColumn("n", F.monotonically_increasing_id()))
    repo = F.substring_index("rel", "/", 1)
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod({h}, 63) as int))")
    known = rows.withColumns({"r": F.xxhash64(repo), "q": F.hash(repo)}).select(bit("r").alias("r"), bit("q").alias("q"), F.explode("pairs").alias("pair"))
    known = known.groupBy("pair").agg(F.bit_or("r").alias("r"), F.bit_or("q").alias("q"))
    held = F.greatest(F.bit_count("r"), F.bit_count("q"))
    known = known.filter(held >= COMMON).select("pair")
    shared = rows.select("n", F.explode("pairs").alias("pair")).join(known, "pair").groupBy("n").agg(F.count("*").alias("shared"))
    rows = rows.select("n", "rel", "phi", F.size("pairs").alias("size")).join(shared, "n", "left")
    rows = rows.join(_sizes(files), "rel", "left")
    share = F.coalesce("shared", F.lit(0)) / F.greatest("size", F.lit(5))
    copied = F.when(share >= 0.85, STRONG).when(share >= 0.7, HALF).otherwise(0.0)
    large = F.when(F.col("bytes") >= LARGE_BYTES, LARGE).otherwise(0.0)
    more = {VENDORED: copied, GENERATED: large, MINIFIED: large, BLOB: large}
    sums = [F.sum(F.col("phi")[k] + more.get(k, F.lit(0.0))).alias(f"f{k}") for k in range(5)]
    return rows.groupBy("rel").agg(*sums)


def _columns(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{k}") for k in range(5)]


def _through(values: list[Column], table: list[list[float]]) -> list[Column]:
    """log sum over y of table[x][y] exp(values[y]), for each x."""
    top = F.greatest(*values)
    return [F.log(sum((F.lit(table[x][y]) * F.exp(values[y] - top) for y in range(5)), F.lit(0.0))) + top for x in range(5)]


_UPWARD = COMPATIBLE
_DOWNWARD = [list(c) for c in zip(*COMPATIBLE, strict=True)]


def _parent(path: Column) -> Column:
    """The folder of a path; of a path without one, the empty root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def beliefs(files: DataFrame) -> DataFrame:
    """(rel, label) of files (rel, f0..f4): evidence combined over the directory tree.

    Messages go up one level of depth at a time and then down. What a directory
    hears from its children is a sum, so one with a third of all files is partially
    aggregated and never gathered.
    """
    own = [c.alias(f"m{k}") for k, c in enumerate(_through(_columns("f"), _UPWARD))]
    files = checkpointed(files.select("rel", _parent(F.col("rel")).alias("dir"), *_columns("f"), *own))
    heard = checkpointed(files.groupBy("dir").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(5)]))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    dirs = heard.select(F.explode(ancestors).alias("dir")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    name = F.substring_index("dir", "/", -1)
    dirs = dirs.join(heard, "dir", "left").select(
        "dir",
        _parent(F.col("dir")).alias("up"),
        depth.alias("depth"),
        *[(F.coalesce(f"m{k}", F.lit(0.0)) + F.when(name.isin(*DIRECTORY_HINTS.get(k, [""])), WEAK if k in DIRECTORY_HINTS else 0.0).otherwise(0.0)).alias(f"u{k}") for k in range(5)],
    )
    dirs = checkpointed(dirs)
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):
        level = dirs.filter(F.col("depth") == d)
        if below is not None:
            level = level.join(below, "dir", "left").select("dir", "up", "depth", *[(F.col(f"u{k}") + F.coalesce(f"m{k}", F.lit(0.0))).alias(f"u{k}") for k in range(5)])
        message = _through(_columns("u"), _UPWARD)
        levels[d] = level = checkpointed(level.select("dir", "up", *_columns("u"), *[c.alias(f"m{k}") for k, c in enumerate(message)]))
        below = level.groupBy(F.col("up").alias("dir")).agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(5)])
    belief = levels[0].select("dir", *[F.col(f"u{k}").alias(f"b{k}") for k in range(5)])
    everywhere = belief
    for d in range(1, deepest + 1):
        parent = belief.withColumnRenamed("dir", "up")
        joined = levels[d].join(parent, "up")
        cavity = [F.col(f"b{k}") - F.col(f"m{k}") for k in range(5)]
        down = _through(cavity, _DOWNWARD)
        belief = checkpointed(joined.select("dir", *[(F.col(f"u{k}") + down[k]).alias(f"b{k}") for k in range(5)]))
        everywhere = everywhere.union(belief)
    down = _through([F.col(f"b{k}") - F.col(f"m{k}") for k in range(5)], _DOWNWARD)
    final = files.join(everywhere, "dir").select("rel", F.array(*[F.col(f"f{k}") + down[k] for k in range(5)]).alias("p"))
    # Of equal beliefs the first label counts, so a file without evidence is handwritten.
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("p", F.array_max("p")).cast("int"))
    return final.select("rel", label.alias("label"))


def labelled_files(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(rel, label) of every path with an ending of a source language; null paths and texts are left out."""
    return beliefs(evidence(parsed, files))


def foreign_files(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(rel) of the files nobody wrote by hand in their repository."""
    return labelled_files(parsed, files).filter(F.col("label") != LABELS[HAND]).select("rel")
