"""Source files that do not parse.

One lexer per language drives a pushdown stack over a whole file: literals,
comments, templates, markup and delimiters. It reports the first unterminated
literal, unbalanced delimiter, premature end or conflict marker and leaves the text
with literals and comments blanked; a few token-order rules over that skeleton then
reject text of another language. Python text that passes the lexer is also parsed.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import spread

# The endings of each language.
ENDINGS = {
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "php": ("php", "phtml"),
    "python": ("py",),
}
LANGUAGE_OF = {e: name for name, endings in ENDINGS.items() for e in endings}

CLOSES = {")": "(", "]": "[", "}": "{"}
MARKS = ("<<<<<<<", ">>>>>>>", "=======", "|||||||")
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)


def language_of(rel: str | None) -> str | None:
    name = (rel or "").rpartition("/")[2]
    return LANGUAGE_OF.get(name.rpartition(".")[2]) if "." in name else None


class Broken(Exception):
    """Why and where a text is no valid file."""


def conflicted(code: str) -> bool:
    return any(m in code for m in MARKS) and CONFLICT.search(code) is not None


def words(text: str) -> str:
    return "|".join(text.split())


# --- JavaScript and TypeScript -------------------------------------------------

_STRING = {
    "'": re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*+'"),
    '"': re.compile(r'"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*+"'),
}
# Plain code, then a pair of delimiters without anything inside to look at, a string, or one telling character.
_STEP = re.compile(
    r"[^()\[\]{}'\"`/<#]*+(?:(\([\w$., :]*+\)|\[[\w$., :]*+\]|\{[\w$., :]*+\})|(" + _STRING["'"].pattern + "|" + _STRING['"'].pattern + r")|([\s\S]))"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_COMMENT = re.compile(r"/\*[\s\S]*?\*/")
_LINE = re.compile(r"[^\n\r]*")
_TAIL_WORD = re.compile(r"[\w$]+$")
_TAG = re.compile(r"<(/?)\s*([A-Za-z_$][\w$.:-]*)?")
_IN_TAG = re.compile(r"\s*(?:(/\s*>)|(>)|(\{)|(\"[^\"]*\"|'[^']*')|[\w$:.=-]+|/\*[\s\S]*?\*/)")
_GENERIC = re.compile(r"\s+extends\s+[\w$\"'{\[(]|\s*,")  # parameters of a type, not a tag
_MARKUP_TEXT = re.compile(r"[^<>{}]*")
_BEFORE_OPERAND = frozenset("return typeof case in of do else void delete throw new instanceof yield await default extends".split())

# Words that may stand before an operand, and between two, on one line.
_JS_PREFIX = frozenset(
    "const let var using return typeof new delete void throw case in of instanceof import export from as function async await yield class extends else do default static get set break continue".split()
)
_TS_PREFIX = _JS_PREFIX | frozenset(
    "type interface declare namespace abstract readonly enum keyof infer public private protected override satisfies is asserts unique module global implements accessor out require".split()
)
_JS_INFIX = frozenset("in of instanceof as from extends while else catch finally with assert await".split())
_TS_INFIX = _JS_INFIX | frozenset("is implements satisfies keyof if".split())
_LEFT = re.compile(r"[\w$.#@\"\]]+\Z")
_RIGHT = re.compile(r"[\w$\"]+")
_SYMBOLS = re.compile(
    r"[-<?:.=+*,(\[$\"](?:(?<=[^-]-)>|(?<=<)\?|(?<=\?)>|(?<=:):|(?<=\.)\.\.\.|(?<==)\s*[)\];,}]|(?<==)\s+=(?!>)|(?<=[=+*,\[])\s*;|(?<=\()\s*,"
    r"|(?<=,)\s*,(?![^\[\]]*\])|(?<=\$)\{|(?<=\")\"[\w$\"])"
)


def _out_of_place(code: str, typed: bool) -> bool:
    """Whether two operands stand side by side, or symbols that never do."""
    prefix, infix = (_TS_PREFIX, _TS_INFIX) if typed else (_JS_PREFIX, _JS_INFIX)
    for line in code.split("\n"):
        parts = line.split()
        # A word that starts statements elsewhere is a name here, unless an operand follows it.
        if parts and (parts[0] in _FOREIGN and len(parts) > 1 and (parts[1][0].isalnum() or parts[1][0] in '_$"') or parts[0][0] == "#" and not parts[0][1:2].isalpha() and parts[0][1:2] not in ("_", "$", "!")):
            return True
        if len(parts) > 1 and parts[-1][-1] == ":" and parts[0] in ("if", "while", "for") and parts[1][0] != "(":
            return True
        for a, b in zip(parts, parts[1:]):
            if a not in prefix and b not in infix and (a[-1].isalnum() or a[-1] in '_$"]') and (b[0].isalnum() or b[0] in '_$"'):
                left = _LEFT.search(a).group()
                if left not in prefix and left[0] not in "@#" and _RIGHT.match(b).group() not in infix:
                    return True
    return _SYMBOLS.search(code) is not None or any(r.search(code) for r in _KEYWORDS) or _FIRST_WORD.match(code) is not None or _BAD_NUMBER.search(code) is not None or _behind_parenthesis(code, infix)


_NUMBER = r"(?:0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?n?)"
_BAD_NUMBER = re.compile(rf"(?<![\w$.])(?=\d)(?!{_NUMBER}(?:\.?\.[A-Za-z_$]|(?![\w$])))")
# Words of statements where none can stand, and declarations without what they declare.
_KEYWORDS = (
    re.compile(r"[rtdvi](?<![\w$.].)(?:(?:eturn|hrow|ypeof|elete|oid)[ \t]+(?:(?:return|if|for|while|const|var|switch|throw|break|continue)\b(?![ \t]*[:=.(,;)\]}]))|mport[ \t]+from[ \t]+\"\")"),
    re.compile(r"[;}]\s*(?:function[ \t]*\*?[ \t]*\(|class[ \t]*\{)"),
    re.compile(r"\breturn[ \t]+return\b"),
)
_FIRST_WORD = re.compile(r"\s*(?:(?:else|finally|case)\b(?!\s*[:=.(,;])|catch\s*[({]|(?:const|var)\s*=|function[ \t]*\*?[ \t]*\(|class[ \t]*\{)")
_BEHIND = re.compile(r"\)[ \t]+([A-Za-z_$][\w$]*|[\d\"])")
_HEAD = re.compile(r"(?<![\w$.])(?:if|while|for|with|await)\s*\Z|@[\w$.]+\s*\Z")


def _opening(code: str, at: int) -> int:
    """Where the parenthesis opens that closes at a place, or -1."""
    depth = 0
    while at >= 0:
        close, open_ = code.rfind(")", 0, at + 1), code.rfind("(", 0, at + 1)
        if open_ < 0:
            return -1
        if close > open_:
            depth += 1
            at = close - 1
        else:
            depth -= 1
            if not depth:
                return open_
            at = open_ - 1
    return -1


def _behind_parenthesis(code: str, infix: frozenset[str]) -> bool:
    """Whether an operand stands behind a parenthesis that is no head of a statement and no decorator's."""
    for m in _BEHIND.finditer(code):
        if m.group(1) not in infix and not _HEAD.search(code, max(0, (at := _opening(code, m.start())) - 80), max(at, 0)):
            return True
    return False


_ELSE, _IF = re.compile(r"(?<![\w$.>:\\])else\b(?!\s*[:=.(,)])"), re.compile(r"(?<![\w$.>\\])(?:else)?if\b")


def _else_without_if(code: str) -> bool:
    return "else" in code and len(_ELSE.findall(code)) > len(_IF.findall(code))


_JS_ONLY = re.compile(r"\(\s*[A-Za-z_$][\w$]*\s*\??:\s*[A-Za-z_$\[{(\"]|(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*:|\)\s*:\s*[\w$<>\[\]|. ]+\s*(?:=>|\{)|\bas\s+(?:const|[A-Z]|string|number|any|unknown)")
_FIRST = re.compile(r"\s*\{\s*(?:\"\"\s*:|\})")
_PREMATURE = re.compile(r"(?:[=+*%&|^<>?:,.(\[{~!-]|(?<![\w$])(?:return|const|let|var|function|class|import|export|new|typeof|extends|if|while|for|else))\s*\Z")
_FOREIGN = frozenset("foreach elif elseif unless def echo fi done esac".split())


def _operand_next(out: list[str]) -> bool:
    """Whether the code so far expects an operand, so that a slash starts a regex and < markup."""
    for piece in reversed(out):
        piece = piece.rstrip()
        if not piece:
            continue
        if piece[-1] == ")":
            code = "".join(out).rstrip()
            at = _opening(code, len(code) - 1)
            return _HEAD.search(code, max(0, at - 80), max(at, 0)) is not None
        if piece[-1] in "]\"}`":
            return piece[-1] == "}"
        word = _TAIL_WORD.search(piece)
        return word is None or word.group() in _BEFORE_OPERAND
    return True


def js_skeleton(src: str, markup: bool) -> str:
    """The code of a text with literals blanked; raises Broken.

    The stack holds open delimiters, `T` for a template whose expression is open,
    `M` for markup whose child expression is open and `A` for an attribute's.
    """
    stack: list[str] = []
    depth: list[list[str]] = []  # outputs of the code around templates and markup
    tags: list[list[str]] = []  # open tags of each markup expression
    out: list[str] = []
    pos, end, last = 0, len(src), 0

    def template(at: int) -> int:
        nonlocal out
        at = _TEMPLATE.match(src, at).end()
        if at >= end:
            raise Broken("unterminated template")
        if src[at] == "`":
            out = depth.pop()
            out.append("``")
            return at + 1
        stack.append("T")
        out = []
        return at + 2

    def in_tag(at: int) -> int:
        """Attributes up to the end of an opening tag, or to an expression among them."""
        nonlocal out
        while True:
            m = _IN_TAG.match(src, at)
            if m is None:
                raise Broken("bad markup")
            at = m.end()
            if m.group(1):
                tags[-1].pop()
                return children(at)
            if m.group(2):
                return children(at)
            if m.group(3):
                stack.append("A")
                out = []
                return at

    def children(at: int) -> int:
        nonlocal out
        while True:
            if not tags[-1]:
                tags.pop()
                out = depth.pop()
                out.append('""')
                return at
            at = _MARKUP_TEXT.match(src, at).end()
            if at >= end:
                raise Broken("unterminated markup")
            c = src[at]
            if c == "{":
                stack.append("M")
                out = []
                return at + 1
            if c != "<":
                raise Broken("bad markup")
            m = _TAG.match(src, at)
            name = m.group(2) or ""
            at = m.end()
            if m.group(1):
                if not tags[-1] or tags[-1].pop() != name or not (m := re.compile(r"\s*>").match(src, at)):
                    raise Broken("unbalanced markup")
                at = m.end()
            else:
                tags[-1].append(name)
                return in_tag(at)

    step = _STEP.match
    while (m := step(src, pos)) is not None:
        kind = m.lastindex
        if kind == 1:
            pos = m.end()
            continue
        i = m.start(kind)
        if kind == 2:
            out.append(src[last:i])
            out.append('""')
            pos = last = m.end()
            continue
        c = src[i]
        if c in "([{":
            stack.append(c)
            pos = i + 1
            continue
        if c in ")]}":
            top = stack.pop() if stack else ""
            if top == CLOSES[c]:
                pos = i + 1
            elif c == "}" and top == "T":
                last = pos = template(i + 1)
            elif c == "}" and top == "M":
                last = pos = children(i + 1)
            elif c == "}" and top == "A":
                last = pos = in_tag(i + 1)
            else:
                raise Broken("unbalanced delimiter")
            continue
        out.append(src[last:i])
        if c == "'" or c == '"':
            raise Broken("unterminated string")
        if c == "`":
            depth.append(out)
            pos = template(i + 1)
        elif c == "/":
            after = src[i + 1 : i + 2]
            if after == "/":
                pos = _LINE.match(src, i).end()
            elif after == "*":
                m = _COMMENT.match(src, i)
                if m is None:
                    raise Broken("unterminated comment")
                out.append("\n" if "\n" in m.group() else " ")
                pos = m.end()
            elif _operand_next(out):
                m = _REGEX.match(src, i)
                if m is None:
                    raise Broken("unterminated regular expression")
                out.append('""')
                pos = m.end()
            else:
                out.append("/")
                pos = i + 1
        elif c == "<":
            m = _TAG.match(src, i)
            if not m.group(1) and (m.group(2) or src[m.end() : m.end() + 1] == ">") and src[i : i + 2] != "<<" and _operand_next(out):
                if markup and _GENERIC.match(src, m.end()):
                    out.append("<")
                    last = pos = i + 1
                    continue
                if not markup and re.compile(r"[^<>;]*(?:/>|</|>[^\n]*</|=\s*[{\"'])").match(src, m.end()):
                    raise Broken("markup in a file without it")
                if markup:
                    depth.append(out)
                    tags.append([m.group(2) or ""])
                    pos = in_tag(m.end())
                    last = pos
                    continue
            out.append("<")
            pos = i + 1
        elif i or src[1:2] != "!":  # a private name
            out.append("#")
            pos = i + 1
        else:
            pos = _LINE.match(src, i).end()
        last = pos
    if stack or depth:
        raise Broken("premature end")
    out.append(src[last:])
    return "".join(out)


def check_js(src: str, language: str) -> None:
    markup = language != "typescript"
    code = js_skeleton(src, markup)
    if conflicted(code):
        raise Broken("conflict marker")
    if _FIRST.match(code) and '"' in code:
        raise Broken("data, not code")
    if _PREMATURE.search(code.rstrip()[-40:]):
        raise Broken("premature end")
    if _out_of_place(code, language != "javascript") or _else_without_if(code):
        raise Broken("token out of place")
    if language == "javascript" and _JS_ONLY.search(code):
        raise Broken("type annotation in JavaScript")


# --- PHP -------------------------------------------------------------------------

_PHP_OPEN = re.compile(r"<\?(?:php(?=\s|$)|=)", re.I)
_PHP_CODE = re.compile(r"[()\[\]{}'\"`#]|/[/*]|\?>|<<<")
_PHP_STRING = {q: re.compile(rf"{q}(?:[^{q}\\]|\\[\s\S])*{q}") for q in "'\"`"}
_PHP_LINE = re.compile(r"(?:(?!\?>)[^\n\r])*")
_HEREDOC = re.compile(r"<<<[ \t]*(['\"]?)([A-Za-z_]\w*)\1\r?\n")
_PHP_PREFIX = words(
    "return echo print new clone throw case use namespace function fn class interface trait enum extends implements const static public private protected abstract final readonly var global"
    " instanceof insteadof as and or xor else elseif include include_once require require_once goto break continue yield from default catch try finally do if while for foreach switch match declare int string float bool array mixed void self object callable iterable null parent"
)
_PHP_ORDER = re.compile(
    rf"(?<![\w$>:\\])(?!(?:{_PHP_PREFIX})\b)[A-Za-z_]\w*[ \t]+(?!(?:as|and|or|xor|instanceof|insteadof|extends|implements|use|from|else|while)\b)[A-Za-z_\"\d]"
    r"|\$\w+[ \t]+(?!(?:as|and|or|xor|instanceof|while)\b)[A-Za-z_$\"\d]"
    r"|\"\"[ \t]*(?!(?:as|and|or|xor|instanceof)\b)[A-Za-z_$\"\d]|\][ \t]+(?!(?:as|and|or|xor|instanceof|use)\b)[A-Za-z_$\"\d]"
    r"|[=+*/,(\[]\s*;|\(\s*,|,\s*,|(?<![=!<>])===?\s*[)\];]|\$(?![\w${])|->\s*[;)]"
    r"|(?<![\w$.])\d[\w.]*[ \t]+(?!(?:as|and|or|xor|instanceof)\b)[A-Za-z_$\"\d]"
    # A statement must end before a line starts with a variable or a statement word.
    r"|[\w\])\"][ \t]*\n\s*(?:\$\w+(?:\s*(?:[-+.*/]?=(?!=)|\(|\[|->))|return\b|foreach\b|throw\b|try\b|echo\b)"
)
_BLOCK_HEAD = re.compile(r"(?:if|elseif|while|for|foreach|else|do|\))[ \t]*\n")
_PHP_PREMATURE = re.compile(r"(?:[=+*%&|^?,.(\[{~!<>-]|\w)\s*\Z")


def php_skeleton(src: str) -> str:
    """The PHP code of a text, literals blanked; text outside the tags is free."""
    out: list[str] = []
    stack: list[str] = []
    m = _PHP_OPEN.search(src)
    while m is not None:
        pos = last = m.end()
        m = None
        while (t := _PHP_CODE.search(src, pos)) is not None:
            i, c = t.start(), t.group()
            pos = t.end()
            if c in "([{":
                stack.append(c)
                continue
            if c in ")]}":
                if not stack or stack.pop() != CLOSES[c]:
                    raise Broken("unbalanced delimiter")
                continue
            out.append(src[last:i])
            if c == "?>":
                out.append(";\n")
                last = pos
                m = _PHP_OPEN.search(src, pos)
                if m is None:
                    last = len(src)
                break
            if c in "'\"`":
                t = _PHP_STRING[c].match(src, i)
                if t is None:
                    raise Broken("unterminated string")
                out.append('""')
                pos = t.end()
            elif c == "/*":
                t = _COMMENT.match(src, i)
                if t is None:
                    raise Broken("unterminated comment")
                out.append("\n" if "\n" in t.group() else " ")
                pos = t.end()
            elif c == "<<<":
                t = _HEREDOC.match(src, i)
                close = t and re.compile(rf"^[ \t]*{t.group(2)}\b", re.M).search(src, t.end())
                if not t or not close:
                    raise Broken("unterminated heredoc")
                out.append('""')
                pos = close.end()
            elif c == "#" and src[pos : pos + 1] == "[":
                pass
            else:
                pos = _PHP_LINE.match(src, i).end()
            last = pos
        else:
            out.append(src[last:])
    if stack:
        raise Broken("premature end")
    return "".join(out)


def check_php(src: str) -> None:
    code = php_skeleton(src)
    if conflicted(code or src):
        raise Broken("conflict marker")
    body = code.rstrip()
    if body and body[-1] not in ";}":
        raise Broken("premature end")
    if (m := _PHP_ORDER.search(code)) and not _BLOCK_HEAD.match(code, m.start()):
        raise Broken("token out of place")
    if _else_without_if(code):
        raise Broken("token out of place")


# --- Python ----------------------------------------------------------------------

_PY_CODE = re.compile(r"[()\[\]{}'\"#]")
_PY_LONG = {q: re.compile(rf"{q * 3}(?:[^\\]|\\[\s\S])*?{q * 3}") for q in "'\""}
_PY_PREFIX = re.compile(r"[rbfuRBFU]{1,2}$")


def py_skeleton(src: str) -> str:
    out: list[str] = []
    stack: list[str] = []
    pos = last = 0
    while (m := _PY_CODE.search(src, pos)) is not None:
        i, c = m.start(), m.group()
        pos = i + 1
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() != CLOSES[c]:
                raise Broken("unbalanced delimiter")
        elif c == "#":
            out.append(src[last:i])
            pos = last = _LINE.match(src, i).end()
        else:
            out.append(src[last:i])
            if src.startswith(c * 3, i):
                m = _PY_LONG[c].match(src, i)
            else:
                m = _STRING[c].match(src, i)
            if m is None:
                raise Broken("unterminated string")
            out.append('""')
            pos = last = m.end()
    if stack:
        raise Broken("premature end")
    out.append(src[last:])
    return "".join(out)


def check_python(src: str) -> None:
    if conflicted(py_skeleton(src)):
        raise Broken("conflict marker")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(src, "source", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise Broken("no Python 3") from e


def why_broken(language: str, source: str) -> str | None:
    """Why the text is no valid file of the language, or None. An empty text is valid."""
    src = source.removeprefix("﻿")
    try:
        if language == "python":
            check_python(src)
        elif language == "php":
            check_php(src)
        else:
            check_js(src, language)
    except Broken as e:
        return str(e)
    return None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rels, languages, why = [], [], []
        for rel, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (language := language_of(rel)) and source is not None:
                rels.append(rel)
                languages.append(language)
                why.append(why_broken(language, source))
        yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(languages, pa.string()), pa.array(why, pa.string())], ["rel", "language", "why"])


def judged_files(parsed: DataFrame) -> DataFrame:
    """(rel, language, why) of every row with a language's ending; why is null for valid text.

    Rows with a null path or text and files of other endings are left out. A
    doubled row is judged twice; a path with several texts has a row for each.
    Stored flags are not read. Each file is lexed whole in one task.
    """
    return spread(parsed.select("rel", "source")).mapInArrow(_judged, "rel string, language string, why string")


def broken_files(parsed: DataFrame) -> DataFrame:
    return judged_files(parsed).filter("why is not null").select("rel").distinct()


def broken_rates(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Files, broken files and their rate per repository and language.

    Repository: ``files.repo`` or, for files never indexed or without one, the first
    segment of the path. Language: by the ending, as stored spellings differ.
    """
    judged = judged_files(parsed).groupBy("rel").agg(F.max("language").alias("language"), F.max(F.col("why").isNotNull()).alias("broken"))
    repos = files.filter("rel is not null").groupBy("rel").agg(F.max("repo").alias("repo"))
    repo = F.coalesce("repo", F.substring_index("rel", "/", 1)).alias("repo")
    out = judged.join(repos, "rel", "left").groupBy(repo, "language").agg(F.count("*").alias("files"), F.count_if("broken").alias("broken"))
    return out.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
