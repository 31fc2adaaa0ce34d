"""Credentials embedded in source code.

A linear-chain conditional random field labels the lexical tokens of whole texts as
outside, beginning or inside a secret, from their shape and their context; no line
is left out beforehand. Viterbi spans say exactly which characters are redacted. The
field is fitted on lines made from templates, labelled by construction, and on real
code without secrets; their number is a parameter.

Texts are labelled many at a time: tokens become small integers, features become
rows of weight tables, and only value tokens can carry a label, so chains are the
runs of value tokens between punctuation.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.credential_lines import Templates, plain_code
from gritstone.session import spread

TRAINING_LINES = 30000  # lines from templates; as many lines of code without secrets at most
EPOCHS = 12
BATCHES = 120
RATE = 0.3
PENALTY = 2e-5
RARITY = 0.5  # log odds against a secret, which is rarer in code than in the lines the field is fitted on
SEED = 17
MASK = "REDACTED"
CHUNK = 1_000_000  # characters of texts labelled at once; a longer text is a chunk of its own
KNOWN_TOKENS = 400_000  # distinct tokens remembered by a task

# --- lexical tokens ----------------------------------------------------------------

_TOKEN = re.compile(
    # What most code consists of comes first: names and marks without a special meaning of their own.
    r"\s*+(?:(?<!['\"`])[A-Za-z_][A-Za-z0-9_]*+(?![./+~!%^&*?#$'=-]|://)"
    r"|(?<!['\"`])[\"'`(){}\[\],;:@=>|]"
    r"|-----(?:BEGIN|END)[A-Z0-9 ]*-----"
    r"|[A-Za-z][A-Za-z0-9+.-]*+://"
    r"|\$\{[^}\s]*\}|<[\w -]+>"
    r"|\\[nrt]"
    r"|[A-Za-z]{2,}+'(?:s|t|re|ve|ll|d|m)\b(?!['\"])"
    # A quoted text without blanks and joints is one token, whatever marks it holds.
    r"|(?<=['\"`])(?:[^\s'\"`\\=:/&.$]++|\$(?!\{)){1,200}+(?<=[^'\"`]{6})(?=['\"`])"
    r"|(?=[A-Za-z+/]*+\d)[A-Za-z0-9+/]{8,}+={1,2}(?=[\"'`\s,;)}@\\]|$)"
    r"|[A-Za-z0-9_./+~!%^&*?#$-]++"
    r"|\S)"
)
# The password of a URL is one token whatever it holds; its last @ ends it.
_URL_PASSWORD = re.compile(r"://[^\s/:@'\"`]*:([^\s/'\"`]+)@")
_URL_MARK = "\x01"
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HEX = re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_JWT = re.compile(r"eyJ[\w-]+\.[\w-]+(?:\.[\w-]*)?")
# Shapes of tokens that name their provider.
_PROVIDER = re.compile(
    r"(?:gh[pousr]_|github_pat_|glpat-|sk_live_|sk_test_|rk_live_|sk-|xox[abprs]-|npm_|pypi-|shpat_|SG\.|hf_|dop_v1_|AIza|ya29\.)[\w.-]{12,}"
    r"|(?:AKIA|ASIA)[0-9A-Z]{16}|[a-z]{2,8}_(?:prod|live|test|dev|stg|staging)_[A-Za-z0-9]{16,}"
)
_IDENT = re.compile(r"\$?[A-Za-z_$][\w$]*")
_MASKED = re.compile(r"(.)\1{3,}")
_STAND_IN = re.compile(
    r"(?i)\$\{.*\}|<.*>|%\w+%|(?:change|replace|fill|insert|redacted|dummy|sample|example|placeholder|fake|todo|tbd|fixme|none|null|undefined|unset|empty)[\w.-]*|your[-_.\w]*|[\w.-]*(?:example|placeholder|change[-_]?me|here)|user(?:name)?|pass(?:word|wd)?|secret|token|api[-_]?key|foo|bar|baz|test|true|false"
)

# Words of names that hold secrets, and words that say a name holds something else.
_SECRET_WORDS = frozenset("password passwd passphrase pwd pass secret token apikey credential credentials creds bearer authorization auth dsn".split())
_KEY_OWNERS = frozenset("api private signing access secret encryption tls ssl ssh master auth service client deploy account rsa hmac".split())
_OTHER_WORDS = frozenset(
    "public integrity etag hash sha digest checksum md5 crc commit revision rev tree trace request uuid guid tenant build label file path name ttl header hint help title message placeholder field prompt url link docs doc length size count policy id type regex pattern version expires expiry fingerprint blob object".split()
)
_SCHEME_WORDS = {"bearer": 1, "basic": 2}


_ENDS_SECRET = re.compile(r"(?<=[a-z])(?:password|passwd|pwd|secret)$|^[a-z]{2,4}(?<!by)(?<!com)(?<!sur)(?<!tres)pass$")
_TELLING = _SECRET_WORDS | _OTHER_WORDS | {"key"}
# A telling word that rather describes the secret beside it, and one that turns a secret's name into another's.
_BESIDE = frozenset("id url request build tenant trace policy header revision version digest tree label hash message".split())
_TURNING = frozenset("label file name ttl header hint length field placeholder type expires expiry path policy id".split())


def name_class(parts: list[str], low: str) -> str:
    """s: a name that holds a secret, o: one that holds something else, n: neither; from the lower-case words of a name."""
    if "pass" in low or "pwd" in low or "secret" in low:
        parts = ["password" if _ENDS_SECRET.search(p) else p for p in parts]
    if _TELLING.isdisjoint(parts):
        return "n"
    held = frozenset(parts)
    other = held & _OTHER_WORDS
    secret = bool(held & _SECRET_WORDS) or any(b == "key" and a in _KEY_OWNERS for a, b in zip(parts, parts[1:]))
    if other and not (secret and other <= _BESIDE):
        # The first telling word decides between the two, unless the other one is not a plain noun.
        first = next(i for i, p in enumerate(parts) if p in _OTHER_WORDS)
        own = next((i for i, p in enumerate(parts) if p in _SECRET_WORDS or p == "key"), 99)
        if not secret or first < own or first == own + 1 and parts[first] in _TURNING:
            return "o"
    return "s" if secret else "o" if other else "n"


_CALL_WORDS = frozenset("connect login logon signin authenticate auth bind password".split())
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{5,}|[^A-Za-z0-9]")


def looks_random(text: str) -> bool:
    """Long, with digits and letters, and for the most part outside words, numbers and separators."""
    if len(text) < 16 or not any(c.isdigit() for c in text) or not any(c.isalpha() for c in text):
        return False
    rest = _WORDS.sub(" ", text)
    loose = len(rest) - rest.count(" ")
    return loose * 2 >= len(text) and sum(c.isdigit() for c in rest) * 10 < len(text) * 8


# Shapes that may carry a label, shapes that may not, and punctuation, each by its number.
VALUES = "word name const words mixed number stand-in provider jwt uuid hex random random-long base64 integrity path env".split()
OTHERS = "scheme pem-private pem-public pem-end escape comment op other".split()
MARKS = list("'\"`(){}[],;:@=<>|\\.")
SHAPE = {s: k for k, s in enumerate([*VALUES, *OTHERS, *MARKS])}
N_SHAPES, N_VALUES = len(SHAPE), len(VALUES)
_SPECIFIC = ("provider", "jwt", "uuid", "hex", "random", "base64")
_DIGIT, _UPPER, _NAME_MARK, _ODD_MARK = (re.compile(x) for x in (r"\d", r"[A-Z]", r"[_$A-Z]", r"[!%^&*?#~+@()\[\]{}]"))
_LABELLED_TEXT = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]")
_COMMENT = re.compile(r"//+!?|#+|--|/\*+|\*+|;+")
_PATH = re.compile(r"(?:\.{1,2}/|/|@|~/).*|[\w.@/-]+\.[a-z][a-z0-9]{0,4}|(?:[\w.@-]*[a-z]{3,}[\w.-]*/)+[\w.*-]*")
_MIXED_CASE = re.compile(r"\d[A-Za-z]+\d|[A-Z]\d|\d[A-Z]|[a-z][A-Z][a-z][A-Z]")
_NUMERAL = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F_]+|[\d._]+(?:[eE][-+]?\d+)?[a-zA-Z%]{0,3})")
_CONSTANT = re.compile(r"(?=[A-Z0-9_]*_)[A-Z][A-Z0-9]*(?:_+[A-Z0-9]+)*")
_NO_WORD = re.compile(r"(.)\1{3,}$|[$#%]?\{.*\}$|<.*>$|%\(?\w*\)?[sd]?$|\$\w+$")
_INSERTED = re.compile(r"[$#%]?\{.*\}|%\(?\w*\)?[sd]?|<.*>|\$\w+")


def shape(t: str, parts: int) -> str:
    """The class of a token's form; ``parts`` is its number of words and numbers."""
    size = len(t)
    if size == 1 and t in SHAPE:
        return t
    if t[0] == "\\" and size == 2:
        return "escape"
    if t[-1] == "/" and t.endswith("://"):
        return "scheme"
    if t[0] == "-" and t.startswith("-----") and t.endswith("-----"):
        return "pem-end" if t.startswith("-----END") else "pem-private" if "PRIVATE" in t else "pem-public" if "BEGIN" in t else "op"
    if not _LABELLED_TEXT.search(t):
        return "stand-in" if _MASKED.fullmatch(t) or _INSERTED.fullmatch(t) else "comment" if _COMMENT.fullmatch(t) else "op"
    if _NO_WORD.match(t) or _STAND_IN.fullmatch(t):
        return "stand-in"
    digit = _DIGIT.search(t) is not None
    if size >= 16:
        if _PROVIDER.fullmatch(t):
            return "provider"
        if digit:
            if t.startswith("eyJ") and _JWT.fullmatch(t):
                return "jwt"
            if size == 36 and _UUID.fullmatch(t):
                return "uuid"
            if size >= 32 and _HEX.fullmatch(t):
                return "hex"
            if t.startswith(("sha256-", "sha384-", "sha512-")):
                return "integrity"
    if "/" in t and t[-1] != "=" and (_PATH.fullmatch(t) or not looks_random(t)):
        return "path" if size < 12 or _PATH.fullmatch(t) or not _MIXED_CASE.search(t) else "random"
    if t in ("getenv", "env") or t.startswith(("process.env", "os.environ", "$_ENV", "import.meta")):
        return "env"
    if digit:
        if _NUMERAL.fullmatch(t):
            return "number"
        if looks_random(t):
            return "random" if size < 64 else "random-long"
    if t[-1] == "=" and size >= 12 and t.count("/") < 4:
        return "base64"
    if t.isalpha():
        return "word" if parts == 1 else "name"
    if _CONSTANT.fullmatch(t):
        return "const"
    if _IDENT.fullmatch(t) and (not digit or _NAME_MARK.search(t)):
        return "name"
    return "mixed" if digit or _ODD_MARK.search(t) else "words"


# Bits of a token's code: shape, kind of name, flags, make-up and size, and the white space before it.
_KIND, _NAMES, _SCHEME_WORD, _CALL, _JOINS, _GOES_ON, _URL, _MAKE, _SIZE, _LEAD, _NEWLINES, _ODD = 6, 8, 10, 12, 13, 14, 15, 16, 19, 22, 42, 62
_KINDS = {"n": 0, "s": 1, "o": 2}
_PLAIN_NAMES, _NAMING = frozenset(("word", "name", "const")), frozenset(("word", "name", "const", "words", "mixed"))
_SIZES = (5, 8, 12, 16, 28, 64, 160)
# An expression surely goes on behind a line that ends so, or before one that begins so.
_JOIN_ENDS, _CONTINUES = frozenset("+.,\\([=:|?&>-"), frozenset("+.|?:=-&)]>")


def _code(token: str) -> int:
    """The code of a token without white space before it."""
    url = token[:1] == _URL_MARK
    t = token[1:] if url else token
    if not t:
        return SHAPE["other"]
    parts, low = _PARTS.findall(t), t.lower()
    s = shape(t, len(parts))
    kind, names, called = 0, 0, False
    if s in _NAMING or low in _SECRET_WORDS:
        words = [p.lower() for p in parts]
        kind, names = _KINDS[name_class(words, low)], 1 if s in _PLAIN_NAMES or low in _SECRET_WORDS else 2
        called = names == 1 and not _CALL_WORDS.isdisjoint(words)
    place, size = SHAPE[s], len(t)
    mark = place >= N_VALUES
    odd = size > 5 and 5 * len(parts) > 2 * sum(map(len, parts))  # letters and digits change as in no word
    make = (low != t and _UPPER.search(t) is not None) | (_DIGIT.search(t) is not None) << 1 | (not t.isalnum()) << 2
    return (
        place
        | kind << _KIND
        | names << _NAMES
        | _SCHEME_WORDS.get(low, 0) << _SCHEME_WORD
        | called << _CALL
        | (mark and t[-1] in _JOIN_ENDS) << _JOINS
        | (mark and t[0] in _CONTINUES) << _GOES_ON
        | url << _URL
        | make << _MAKE
        | bisect(_SIZES, size) << _SIZE
        | odd << _ODD
    )


class _Codes(dict):
    """Codes of tokens as they stand in the text, white space before them included."""

    def __missing__(self, token: str) -> int:
        if len(self) > KNOWN_TOKENS:
            self.clear()
        bare = token.lstrip()
        lead = len(token) - len(bare)
        if lead:
            code = self[bare] | min(lead, 2**20 - 1) << _LEAD | min(token.count("\n", 0, lead), 2**20 - 1) << _NEWLINES
        else:
            code = _code(token)
        self[token] = code
        return code


_codes = _Codes()


# What stands around the rows of a key: comment prefixes, quotes and joints of strings.
_ROW = re.compile(r"(?:[ \t\"'`+.,>]|//|#|\*|--|;|<!--)*(?P<row>.*?)(?:\\[nr]|[\"'`+.,;) \t\r\\])*$")
_KEY_ROW = re.compile(r"[A-Za-z0-9+/]{1,200}={0,2}")
_KEY_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:[ \t].*")  # Proc-Type, DEK-Info, Comment
_SEGMENT = re.compile(r"\\[nr]|(?P<row>(?:[^\n\\]|\\(?![nr]))+)")


def _key_end(text: str, begin: int, end: int) -> int:
    """Where the key block ends that begins on a line ending at ``end``.

    At its END marker, unless most of what stands between is no key at all, as where
    code names both markers. Where that is missing, behind the last row that looks like text of a
    key once what stands around rows, headers and blank rows are taken off.
    """
    marker = text.find("-----END", begin)
    other = text.find("-----BEGIN", begin + 1)
    if marker >= 0 and (other < 0 or marker < other):
        rows = [r for x in text[end + 1 : max(marker, end + 1)].split("\n") if (r := _ROW.match(x)["row"])]
        if sum(bool(_KEY_ROW.fullmatch(r) or _KEY_HEADER.fullmatch(r)) for r in rows) * 2 >= len(rows):
            stop = text.find("\n", marker)
            return len(text) if stop < 0 else stop
    last, full = end, False
    while end < len(text):
        stop = text.find("\n", end + 1)
        stop = len(text) if stop < 0 else stop
        row = _ROW.match(text[end + 1 : stop])["row"]
        if _KEY_ROW.fullmatch(row) and (len(row) >= 16 or row.endswith("=") or full and len(row) % 4 == 0 and re.search(r"[0-9+/]", row)):
            last, full = stop, len(row) >= 16
        elif row and not _KEY_HEADER.fullmatch(row):
            break
        else:
            full = False
        end = stop
    return last

def key_blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, private) of the key blocks of a text, from the begin marker on."""
    out, at = [], text.find("-----BEGIN")
    while at >= 0:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if text.find("-----END", at, end) < 0:
            end = _key_end(text, at, end)
        out.append((at, end, "PRIVATE" in text[at : text.find("-----", at + 10)]))
        at = text.find("-----BEGIN", end)
    return out


def _key_tokens(text: str, start: int, stop: int, found: list[tuple[int, int]], shapes: np.ndarray, first: int) -> None:
    """In a private key, read short rows as rows and headers as no values; both depend on the row they stand in."""
    marks = [k for k, (a, _) in enumerate(found) if shapes[first + k] == SHAPE["pem-end"]]
    to = found[marks[0]][0] if marks else stop
    j = 1
    for m in _SEGMENT.finditer(text, found[0][1], to):
        if m["row"] is None:
            continue
        row = _ROW.match(m.group())
        body, at, until = row["row"], m.start() + row.start("row"), m.start() + row.end("row")
        kind = "stand-in" if _KEY_HEADER.fullmatch(body) else "random-long" if len(body) < 16 and _KEY_ROW.fullmatch(body) else ""
        while j < len(found) and found[j][0] < until:
            if kind and found[j][1] > at and shapes[first + j] < N_VALUES:
                shapes[first + j] = SHAPE[kind]
            j += 1


@dataclass
class Tokens:
    """Tokens of several texts, in reading order: code first and comments behind it within a text."""

    text: np.ndarray  # number of the text
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray  # from 0
    shape: np.ndarray
    block: np.ndarray  # the line on which the key block begins, or -1
    quote: np.ndarray  # number of the quoted stretch, or -1
    value: np.ndarray  # positions of value tokens
    chain: np.ndarray  # whether a value token directly follows another one, aligned with value
    features: np.ndarray  # rows of the weight table, one line per value token
    rows: int  # of the weight table


def _last(mask: np.ndarray) -> np.ndarray:
    """The position of the last marked element strictly before each one, or -1."""
    at = np.where(mask, np.arange(len(mask)), -1)
    out = np.full(len(mask), -1)
    if len(mask) > 1:
        out[1:] = np.maximum.accumulate(at)[:-1]
    return out


def _quoted(shapes: np.ndarray, row: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The number of the quoted stretch each token stands in, or -1; only backticks go on over line ends."""
    n = len(shapes)
    kinds = [SHAPE[q] for q in "'\"`"]
    at = np.flatnonzero((shapes >= kinds[0]) & (shapes <= kinds[2]))
    edge = np.zeros(n + 1, np.int32)
    number = np.zeros(n + 1, np.int32)
    opened, since, where, inside = -1, -1, -1, -1
    count = 0
    for k, q, r, x in zip(at.tolist(), shapes[at].tolist(), row[at].tolist(), text[at].tolist(), strict=True):
        if opened >= 0 and (x != inside or opened != kinds[2] and r != where):
            opened = -1
        if opened < 0:
            opened, since, where, inside = q, k, r, x
        elif q == opened:
            count += 1
            edge[since + 1] += 1
            edge[k] -= 1
            number[since + 1] = count
            opened = -1
    held = np.cumsum(edge[:n]) > 0
    return np.where(held, np.maximum.accumulate(number[:n]), -1)


class Features:
    """Numbers features: each is a mix of small codes with a stretch of the weight table of its own."""

    def __init__(self) -> None:
        self.size, self.columns = 0, []

    def add(self, *codes: tuple[np.ndarray, int]) -> None:
        row = np.zeros(len(codes[0][0]), np.int64)
        width = 1
        for code, n in codes:
            row = row * n + code
            width *= n
        self.columns.append(row + self.size)
        self.size += width


_CORE = np.array([VALUES.index("random") if s in _SPECIFIC else k for k, s in enumerate(VALUES)])


def analyse(texts: list[str]) -> Tokens:
    """Tokens, context and features of whole texts."""
    found: list[str] = []
    counts = []
    blocks: list[list[tuple[int, int, bool]]] = []
    for text in texts:
        before = len(found)
        if "://" in text and "@" in text:
            at = 0
            for m in _URL_PASSWORD.finditer(text):
                found += _TOKEN.findall(text[at : m.start(1)])
                found.append(_URL_MARK + m.group(1))
                at = m.end(1)
            found += _TOKEN.findall(text[at:])
        else:
            found += _TOKEN.findall(text)
        counts.append(len(found) - before)
        blocks.append(key_blocks(text) if "-----BEGIN" in text else [])
    n = len(found)
    codes = np.fromiter(map(_codes.__getitem__, found), np.int64, n)
    url = (codes >> _URL & 1).astype(bool)
    lengths = np.fromiter(map(len, found), np.int64, n) - url
    lead = codes >> _LEAD & 2**20 - 1
    newlines = codes >> _NEWLINES & 2**20 - 1
    for k in np.flatnonzero(lead == 2**20 - 1).tolist():  # more white space than a code can tell
        lead[k] = len(found[k]) - len(found[k].lstrip())
        newlines[k] = found[k].count("\n", 0, lead[k])
    shapes = (codes & 63).astype(np.int16)
    text = np.repeat(np.arange(len(texts)), counts)
    heads = np.cumsum([0, *counts])[:-1]
    ends, lines = np.cumsum(lengths), np.cumsum(newlines)
    bases = np.append(0, ends)[heads] if n else heads
    ends = ends - np.repeat(bases, counts)
    starts = ends - lengths + lead
    lines = lines - np.repeat(np.append(0, lines)[heads], counts) if n else lines
    block, pem = np.full(n, -1), np.zeros(n, np.int8)
    for x, found_blocks in enumerate(blocks):
        for a, b, private in found_blocks:
            i, j = heads[x] + np.searchsorted(starts[heads[x] : heads[x] + counts[x]], [a, b])
            pem[i:j] = 2 - private
            if private and j > i:
                block[i:j] = lines[i]
                _key_tokens(texts[x], a, b, list(zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)), shapes, i)
    # Comments are read behind the code, so what stands in them does not part a statement.
    first = np.ones(n, bool)
    first[1:] = (lines[1:] != lines[:-1]) | (text[1:] != text[:-1])
    mark = (shapes == SHAPE["comment"]) & (first | (lead > 0)) & (block < 0) | (shapes == SHAPE[";"]) & first
    line_first = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, int)
    comment = (np.maximum.accumulate(np.where(mark, np.arange(n), -1)) >= line_first) if n else np.zeros(0, bool)
    comment &= block < 0
    # A comment behind code that names a secret tells of the code before it.
    told = comment & ((codes >> _KIND & 3) == 1) & (codes >> _NAMES & 3 > 0)
    row = np.cumsum(first) - 1
    named_row = np.zeros(row[-1] + 1 if n else 0, bool)
    named_row[row[told]] = True
    noted = named_row[row] & ~comment
    order = np.flatnonzero(~mark)
    order = order[np.lexsort((comment[order], text[order]))]
    take = lambda a: a[order]
    text, starts, ends, lines, shapes, block, lead, codes, url, comment, noted, pem = map(take, (text, starts, ends, lines, shapes, block, lead, codes, url, comment, noted, pem))
    n = len(order)
    every = np.arange(n)
    part = text * 2 + comment
    row = np.ones(n, bool)
    row[1:] = (lines[1:] != lines[:-1]) | (part[1:] != part[:-1])
    turn = np.ones(n, bool)
    turn[1:] = part[1:] != part[:-1]
    joins, goes_on = codes >> _JOINS & 1, codes >> _GOES_ON & 1
    fresh = turn.copy()
    fresh[1:] |= row[1:] & (joins[:-1] == 0) & (goes_on[1:] == 0)
    statement = np.maximum.accumulate(np.where(fresh, every, 0)) if n else every
    quote = _quoted(shapes, np.cumsum(row), part)
    is_quote = (shapes >= SHAPE["'"]) & (shapes <= SHAPE["`"])

    def beside(values: np.ndarray, by: int, none: int) -> np.ndarray:
        """Of the token so many places on; ``none`` beyond the text and its part."""
        out = np.full(n, none, values.dtype)
        if abs(by) < n:
            i, j = (slice(None, n - by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, n + by))
            out[i] = np.where(part[i] == part[j], values[j], none)
        return out

    none = N_SHAPES
    before, before2 = beside(shapes, -1, none), beside(shapes, -2, none)
    after, after2 = beside(shapes, 1, none), beside(shapes, 2, none)
    same_row = beside(np.cumsum(row), 1, -1) == np.cumsum(row)
    past = np.where((after >= SHAPE["'"]) & (after <= SHAPE["`"]), after2, after)  # what follows behind a quote
    sets = np.isin(past, (SHAPE["="], SHAPE[":"])) & same_row
    kind, names = codes >> _KIND & 3, codes >> _NAMES & 3
    sets &= ~((before == SHAPE[":"]) & (past == SHAPE["="]) & (quote < 0))  # a type between a name and its value
    owns = (names == 1) & ((kind != 0) | sets) | (names == 2) & (kind != 0) & np.isin(after, [SHAPE[c] for c in "=:'\"("])
    owns |= (shapes < N_VALUES) & sets & (quote >= 0)
    at = _last(owns)
    known = at >= statement
    # Names by kind, and calls named like a secret.
    owner = np.where(known, kind[at] + 2 * ((kind[at] == 1) & (after[at] == SHAPE["("])), 0) if n else kind
    gap = every - at
    far = np.where(known, (gap > 3).astype(int) + (gap > 6) + (gap > 12), 4)
    value_like = (shapes < N_VALUES) & (shapes > VALUES.index("const"))
    word = codes >> _SCHEME_WORD & 3
    at = _last(word > 0)
    bearer = np.where((at >= statement) & (_last(value_like) < at), word[at], 0) if n else word
    env = (_last(shapes == SHAPE["env"]) >= statement).astype(int)
    broken = (lead > 0) | is_quote
    broken_at = np.maximum.accumulate(np.where(broken, every, -1)) if n else every
    in_url = (_last(shapes == SHAPE["scheme"]) >= broken_at).astype(int) & (_last(shapes == SHAPE["scheme"]) >= statement)
    call = (codes >> _CALL & 1 > 0) & (after == SHAPE["("])
    called = _last(call)
    calls = ((called >= statement) & (called > _last(shapes == SHAPE[")"]))).astype(int)
    commas = np.cumsum(shapes == SHAPE[","])
    calls = np.where(calls > 0, 1 + np.minimum(commas - commas[called], 2), 0) if n else calls
    v = np.flatnonzero(shapes < N_VALUES)
    pick = lambda a, size: (a[v].astype(np.int64), size)
    s = pick(shapes, N_VALUES)
    core = (_CORE[shapes[v]] if len(v) else s[0], N_VALUES)
    own, far, bear, url_code = pick(owner, 4), pick(far, 5), pick(bearer, 3), pick(url.astype(int) + (in_url > 0), 3)
    placed = pick(quote >= 0, 2)
    around = pick(((before >= SHAPE["'"]) & (before <= SHAPE["`"])).astype(int) * 2 + ((after >= SHAPE["'"]) & (after <= SHAPE["`"])), 4)
    make, size = pick((codes >> _MAKE & 7) + 8 * (codes >> _ODD), 16), pick(codes >> _SIZE & 7, 8)
    wide = N_SHAPES + 1
    f = Features()
    f.add(s)
    f.add(s, own, around)
    f.add(s, own, far)
    f.add(core, own, placed, bear)
    f.add(s, url_code)
    f.add(core, pick(before, wide), own)
    f.add(core, pick(before, wide), pick(before2, wide))
    f.add(core, pick(after, wide), placed)
    f.add(core, pick(past, wide), own)
    f.add(core, pick(pem, 3))
    f.add(s, bear)
    f.add(core, pick(env, 2), own, placed)
    f.add(core, pick(comment, 2), own)
    f.add(core, make, size)
    f.add(make, size, own, around)
    f.add(core, pick(calls, 4), around, make)
    f.add(s, pick(kind, 4), own)
    f.add(pick(kind, 4), around, pick(past, wide))
    f.add(core, pick((every - statement < 3), 2), own)
    f.add(core, pick(noted, 2), around)
    stand = pick(np.isin(shapes, [SHAPE[x] for x in ("stand-in", "env", "path", "const")]), 2)
    f.add(stand, url_code)
    f.add(stand, pick(pem, 3), (size[0] > 1, 2))
    f.add(stand, own, around, pick(codes >> _ODD, 2))
    f.add(stand, pick(noted, 2), own, around)
    chain = np.zeros(len(v), bool)
    chain[1:] = (v[1:] == v[:-1] + 1) & ~turn[v[1:]] & (block[v[1:]] == block[v[:-1]])
    return Tokens(text, starts, ends, lines, shapes, block, quote, v, chain, np.stack(f.columns, 1).astype(np.int32), f.size)



# --- the field ------------------------------------------------------------------------

OUT, BEGIN, INSIDE = range(3)
_FORBIDDEN = -1e9


@dataclass
class Field:
    """Weights of features and moves[a][b] from label a to b; inside never follows outside."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        out = np.zeros((len(tokens.value), 3), np.float32)
        for k in range(tokens.features.shape[1]):
            out += self.weights[tokens.features[:, k]]
        return out

    def viterbi(self, tokens: Tokens) -> np.ndarray:
        """The best label of every value token.

        A token whose score for outside exceeds the others by more than moves could
        ever make up for is outside on every best path; it parts the chain there, so
        what is left to walk are short stretches, all of them at once.
        """
        s = self.scores(tokens).astype(np.float64)
        s[:, OUT] += RARITY
        n, m = len(s), self.moves
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        allowed = m[m > _FORBIDDEN / 2]
        slack = np.full(n, 3 * (allowed.max() - allowed.min()))
        linked = np.append(tokens.chain[1:], False)  # whether the next one is chained to this one
        slack[:-1] += np.where(linked[:-1], np.maximum(s[1:, INSIDE] - s[1:, BEGIN], 0), 0)
        sure = s[:, OUT] - s[:, 1:].max(1) > slack
        left = np.flatnonzero(~sure)
        if not len(left):
            return labels
        behind = tokens.chain & np.append(False, sure[:-1])
        ahead = linked & np.append(sure[1:], False)
        goes = tokens.chain & ~behind
        step = np.zeros(n, np.int64)
        position = np.arange(n) - np.maximum.accumulate(np.where(goes, 0, np.arange(n)))
        step[left] = position[left]
        order = left[np.argsort(step[left], kind="stable")]
        bounds = np.searchsorted(step[order], np.arange(step[order[-1]] + 2))
        best, source = np.zeros((n, 3)), np.zeros((n, 3), np.int8)
        last = ahead[:, None] * m[:, OUT]
        for p in range(len(bounds) - 1):
            at = order[bounds[p] : bounds[p + 1]]
            if p:
                ways = best[at - 1][:, :, None] + m
                source[at] = ways.argmax(1)
                best[at] = ways.max(1) + s[at]
            else:
                best[at] = s[at] + behind[at][:, None] * m[OUT]
                best[at, INSIDE] = _FORBIDDEN
        ends = order[~goes[np.minimum(order + 1, n - 1)] | (order == n - 1) | sure[np.minimum(order + 1, n - 1)]]
        labels[ends] = (best[ends] + last[ends]).argmax(1)
        for p in range(len(bounds) - 2, 0, -1):
            at = order[bounds[p] : bounds[p + 1]]
            labels[at - 1] = source[at, labels[at]]
        return labels


def _slice(tokens: Tokens, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of value tokens a to b, and those of them that are chained to the one before."""
    moved = np.flatnonzero(tokens.chain[a:b])
    return tokens.features[a:b], moved[moved > 0]


def fit(tokens: Tokens, labels: np.ndarray, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Gradient ascent on the log likelihood, a batch of texts at a time, with steps by the inverse root of past squares."""
    weights, moves = np.zeros((tokens.rows, 3), np.float32), np.zeros((3, 3))
    moves[OUT, INSIDE] = _FORBIDDEN
    squares, move_squares = np.full(weights.shape, 1e-2, np.float32), np.full((3, 3), 1.0)
    heads = np.flatnonzero(~tokens.chain)
    cuts = [*heads[np.linspace(0, len(heads) - 1, batches + 1).astype(int)[:-1]], len(labels)]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        features, moved = _slice(tokens, a, b)
        goes = np.zeros(b - a, bool)
        goes[moved] = True
        position = np.arange(b - a) - np.maximum.accumulate(np.where(goes, 0, np.arange(b - a)))
        order = np.argsort(position, kind="stable")
        bounds = np.searchsorted(position[order], np.arange(position.max() + 2))
        seen = np.zeros((3, 3))
        np.add.at(seen, (labels[a:b][moved - 1], labels[a:b][moved]), 1)
        parts.append((features, moved, [order[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], np.eye(3)[labels[a:b]], seen))
    for _ in range(epochs):
        for features, moved, steps, target, seen in parts:
            n = len(target)
            s = np.zeros((n, 3), np.float32)
            for k in range(features.shape[1]):
                s += weights[features[:, k]]
            ahead, after = np.zeros((n, 3)), np.zeros((n, 3))
            for p, at in enumerate(steps):
                if p:
                    ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + moves, axis=1) + s[at]
                else:
                    ahead[at] = s[at]
                    ahead[at, INSIDE] = _FORBIDDEN
            for at in reversed(steps[1:]):
                after[at - 1] = np.logaddexp.reduce(moves + (s[at] + after[at])[:, None, :], axis=2)
            each = ahead + after
            z = np.logaddexp.reduce(each, axis=1)
            slope = target - np.exp(each - z[:, None])
            pairs = np.exp(ahead[moved - 1][:, :, None] + moves + (s[moved] + after[moved])[:, None, :] - z[moved][:, None, None]).sum(0)
            rows = np.flatnonzero(np.abs(slope).max(1) > 1e-3)
            at = features[rows].ravel()
            used, where = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(where, np.repeat(slope[rows, y], features.shape[1]), len(used)) for y in range(3)], 1).astype(np.float32)
            grad -= penalty * n * weights[used]
            squares[used] += grad * grad
            weights[used] += rate * grad / np.sqrt(squares[used])
            g = np.where(moves > _FORBIDDEN / 2, seen - pairs, 0)
            move_squares += g * g
            moves = moves + rate * g / np.sqrt(move_squares)
    return Field(weights, moves)


def labelled(texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """Tokens of texts whose secrets stand between the marks « and », and the label of each value token."""
    clean, marked = [], []
    for text in texts:
        pieces = re.split("[«»]", text)
        clean.append("".join(pieces))
        inside = np.zeros(len(clean[-1]) + 1, bool)
        at = 0
        for k, piece in enumerate(pieces):
            inside[at : at + len(piece)] = k % 2
            at += len(piece)
        marked.append(inside)
    tokens = analyse(clean)
    v = tokens.value
    held = np.array([marked[x][a] for x, a in zip(tokens.text[v].tolist(), tokens.start[v].tolist(), strict=True)], bool)
    touches = np.append(False, (tokens.end[v][:-1] == tokens.start[v][1:])) & tokens.chain
    return tokens, np.where(held, np.where(touches & np.append(False, held[:-1]), INSIDE, BEGIN), OUT).astype(np.int8)


@cache
def trained(lines: int = TRAINING_LINES) -> Field:
    """The field fitted on so many template lines, half of them with a secret, and as much code without any."""
    made = Templates(SEED)
    texts = [made.positive() if k % 2 else made.negative() for k in range(lines)]
    texts += plain_code(lines)
    random.Random(SEED).shuffle(texts)
    return fit(*labelled(texts))


# --- over texts --------------------------------------------------------------------------


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of stretches of bounded size; a long text is never cut."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > CHUNK:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


def spans(texts: list[str], field: Field) -> Iterator[tuple[int, int, int, int]]:
    """(text, line, start, end) of every run of secret characters, in the order of texts and characters.

    Pieces of one quoted text with nothing but marks between them are one run. All
    pieces of a key block count at its first line.
    """
    for base, chunk in _chunks(texts):
        t = analyse(chunk)
        hits = t.value[np.flatnonzero(field.viterbi(t))]
        if not len(hits):
            continue
        hits = hits[np.lexsort((t.start[hits], t.text[hits]))]
        columns = (t.text[hits], t.line[hits], t.start[hits], t.end[hits], t.block[hits], t.quote[hits])
        last: list[int] | None = None
        for x, line, start, end, block, quote in zip(*(c.tolist() for c in columns), strict=True):
            line = block if block >= 0 else line
            if last is not None and x == last[0]:
                between = chunk[x][last[3] : start]
                if line == last[1] and quote == last[5] and (not between or quote >= 0 and block < 0 and not re.search(r"[\s\w'\"`\\]", between)):
                    last[3] = end
                    continue
            if last is not None:
                yield base + last[0], last[1] + 1, last[2], last[3]
            last = [x, line, start, end, block, quote]
        if last is not None:
            yield base + last[0], last[1] + 1, last[2], last[3]


def redact(text: str, field: Field) -> str:
    pieces, at = [], 0
    for _, _, a, b in spans([text], field):
        pieces += [text[at:a], MASK]
        at = b
    return "".join([*pieces, text[at:]])


def _texts(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_key, text) of both kinds of record; null keys and texts hold nothing."""
    files = parsed.select(F.lit("file").alias("record_kind"), F.col("rel").alias("record_key"), F.col("source").alias("text"))
    other = findings.select(F.lit("finding").alias("record_kind"), F.col("id").alias("record_key"), F.col("evidence").alias("text"))
    return files.union(other).filter("record_key is not null and text is not null")


def found_secrets(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_key, line) of every line that holds a secret, doubled rows counting once.

    Lines are split at line feeds and counted from 1; a key block counts at its
    first line, the pieces of another secret each at their own. Every line of every
    text is labelled, very long ones whole. Empty texts hold nothing.
    """
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = dict.fromkeys((x, line) for x, line, _, _ in spans(batch.column(2).to_pylist(), field))
            at = pa.array([x for x, _ in hits], pa.int32())
            lines = pa.array([line for _, line in hits], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), lines], ["record_kind", "record_key", "line"])

    return spread(_texts(parsed, findings)).mapInArrow(run, "record_kind string, record_key string, line int").distinct()


def redacted_texts(parsed: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_key, text) of every record with a secret, with only the secret characters replaced."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            clean: dict[int, list[str]] = {}
            done: dict[int, int] = {}
            for x, _, a, b in spans(texts, field):
                clean.setdefault(x, []).extend((texts[x][done.get(x, 0) : a], MASK))
                done[x] = b
            at = pa.array(list(clean), pa.int32())
            out = pa.array(["".join([*pieces, texts[x][done[x] :]]) for x, pieces in clean.items()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), out], ["record_kind", "record_key", "text"])

    return spread(_texts(parsed, findings)).mapInArrow(run, "record_kind string, record_key string, text string").distinct()
