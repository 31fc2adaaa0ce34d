"""Encoding of the whole corpus with a public byte-level tokenizer.

Encoding is a monoid: a text is cut into halves again and again, leaves are
encoded, and neighbours are joined by encoding a window around their boundary
that grows until the pieces outside it provably stay as they are. Leaves of all
texts are spread over the cluster and joined up a tree, two neighbours at a time,
so the work on a very long text is shared too.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed, discard, shuffle_partitions, spread

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
LEAF = 4096  # characters encoded at once
BATCH = 256  # leaves handed to the tokenizer together
DOUBLES = 100_000  # doubled keys that may be broadcast, 16 bytes each
# A piece is settled when the pattern that made it saw no end of text: no rule of
# the splitting pattern looks more than three characters past the start of a piece
# or one past its end.
AHEAD = 3
WINDOW = 64


# How byte-level vocabularies of this family cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def fast_encoder(path: str):
    """A second public library's encoder of the same vocabulary, several times as fast, or None.

    It merges by id where the first one merges by rank, so it is used only where
    ids follow the ranks and the text is cut by the common pattern.
    """
    import tiktoken

    whole = json.loads(Path(path).read_text(encoding="utf-8"))
    cut, model = whole["pre_tokenizer"] or {}, whole["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not whole["normalizer"] and not whole["post_processor"]
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if not plain or any(b - a != 1 for a, b in zip(ids, ids[1:])) or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    ranks = {piece: k for k, piece in enumerate(_pieces(path)) if piece}
    return tiktoken.Encoding("leaves", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@cache
def tokenizer(path: str):
    """A tokenizer whose special strings are ordinary text."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Codec:
    """Encode and join; a node is (ids, starts of pieces in characters, index of each piece's first id)."""

    def __init__(self, path: str):
        self.t = tokenizer(path)
        self.fast = fast_encoder(path)

    def node(self, text: str) -> tuple[list[int], list[int], list[int]]:
        e = self.t.encode(text, add_special_tokens=False)
        starts, at, last = [], [], None
        for k, (word, span) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word != last:
                starts.append(span[0])
                at.append(k)
                last = word
        return e.ids, starts, at

    def settled(self, node, length: int) -> int:
        """How many leading pieces of a text of this length no text after it can change."""
        _, starts, _ = node
        n = len(starts)
        # Piece k ends where the next one starts; the last always touches the end.
        k = n - 1
        while k > 0 and (starts[k - 1] > length - AHEAD or starts[k] > length - 1):
            k -= 1
        return max(k, 0)

    def join(self, left_text: str, left, right_text: str, right):
        """The node of the concatenation.

        Settled pieces of the left stay. Text from the first unsettled piece on is
        encoded with a growing window of the right; as a piece depends only on the
        text from its start on, the first settled piece of the window that starts
        where a piece of the right does proves all later ones.
        """
        if not left_text:
            return right
        if not right_text:
            return left
        keep = self.settled(left, len(left_text))
        cut = left[1][keep] if left[1] else 0
        tail = left_text[cut:]
        reach, shift = WINDOW, len(left_text)
        begin = {s: k for k, s in enumerate(right[1])}
        while True:
            whole = reach >= len(right_text)
            text = tail + right_text[:reach]
            window = self.node(text)
            pieces = len(window[1]) if whole else self.settled(window, len(text))
            meet = next((k for k in range(pieces) if window[1][k] >= len(tail) and window[1][k] - len(tail) in begin), None)
            if meet is not None or whole:
                break
            reach *= 2
        ids, starts, at = left[0][: left[2][keep]] if left[2] else [], left[1][:keep], left[2][:keep]
        upto = len(window[1]) if meet is None else meet
        last = len(window[0]) if meet is None else window[2][meet]
        base = len(ids)
        ids = ids + window[0][:last]
        starts = starts + [cut + s for s in window[1][:upto]]
        at = at + [base + k for k in window[2][:upto]]
        if meet is not None:
            first = begin[window[1][meet] - len(tail)]
            base = len(ids) - right[2][first]
            ids = ids + right[0][right[2][first] :]
            starts = starts + [shift + s for s in right[1][first:]]
            at = at + [base + k for k in right[2][first:]]
        return ids, starts, at

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; those that are a leaf as a whole need no pieces."""
        if self.fast:
            return [[] if not t else self.fast.encode_ordinary(t) if len(t) <= LEAF else self.encode(t)[0] for t in texts]
        out: list[list[int]] = [[]] * len(texts)
        leaves = [k for k, t in enumerate(texts) if t and len(t) <= LEAF]
        for at in range(0, len(leaves), BATCH):
            some = leaves[at : at + BATCH]
            for k, e in zip(some, self.t.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = e.ids
        for k, t in enumerate(texts):
            if t and len(t) > LEAF:
                out[k] = self.encode(t)[0]
        return out

    def encode(self, text: str):
        """Halve until a leaf fits, encode, join."""
        if len(text) <= LEAF:
            return self.node(text)
        half = len(text) // 2
        return self.join(text[:half], self.encode(text[:half]), text[half:], self.encode(text[half:]))


@cache
def codec(path: str) -> Codec:
    return Codec(path)


@cache
def _pieces(path: str) -> list[bytes]:
    """The bytes of every id."""
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    # Byte-level vocabularies write each byte as a printable character: itself, or the next free one from 256 on.
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(kept)))}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, k in vocab.items():
        if all(c in byte_of for c in piece):
            out[k] = bytes(byte_of[c] for c in piece)
    return out


def decode(ids: list[int], path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> str:
    """Concatenate the bytes of ids; the text comes back exactly."""
    pieces = _pieces(path)
    return b"".join(pieces[i] for i in ids).decode("utf-8", "replace")


_NODE = "doc_id long, n long, size int, text string, ids array<int>, starts array<int>, at array<int>"
_NODE_NAMES = [c.split(" ")[0] for c in _NODE.split(", ")]
_NODE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3]


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NODE_TYPES, strict=True)], _NODE_NAMES)


def _without_doubles(documents: DataFrame) -> DataFrame:
    """(doc_id, text), equal rows once. Doubled keys are found among hashes, and only their rows are moved.

    The doubled keys are broadcast up to DOUBLES of them; where a corpus has more,
    rows of one key meet in a shuffle.
    """
    rows = documents.select("doc_id", "text")
    keys = rows.select("doc_id", F.xxhash64("text").alias("hash")).groupBy("doc_id", "hash").agg(F.count("*").alias("n"))
    doubled = checkpointed(keys.filter("n > 1").select(F.col("doc_id").alias("d"), "hash"))
    if doubled.count() > DOUBLES:
        return rows.distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("hash"))
    once = rows.join(F.broadcast(doubled), same, "left_anti")
    return once.union(rows.join(F.broadcast(doubled), same, "left_semi").distinct())


def _encoded(documents: DataFrame, path: str, task: int, counted: bool) -> DataFrame:
    """(doc_id, ids) or, counted, (doc_id, tokens) of every row."""
    rows = _without_doubles(documents)
    schema = f"doc_id long, {'tokens long' if counted else 'ids array<int>'}"

    def out(docs: pa.Array, ids: list) -> pa.RecordBatch:
        values = pa.array([len(i) for i in ids], pa.int64()) if counted else pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([docs, values], ["doc_id", "tokens" if counted else "ids"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            yield out(batch.column(0), c.ids(batch.column(1).to_pylist()))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One pass over a long text: each segment is cut where the last one ended.
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, len(text), task)
                for k in range(0, len(starts), 64):
                    part = starts[k : k + 64]
                    columns = [pa.array([key] * len(part), pa.int64()), pa.array(range(k, k + len(part)), pa.int64()), pa.array([len(starts)] * len(part), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([text[i : i + task] for i in part], pa.string())], ["doc_id", "n", "size", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for doc, n, size, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield _nodes([(doc, n, size, text, *c.encode(text))])

    def joined(key, group: pa.Table) -> pa.Table:
        c = codec(path)
        nodes = sorted(group.to_pylist(), key=lambda r: r["n"])
        node = nodes[0]
        parts = (node["text"], (node["ids"], node["starts"], node["at"]))
        for r in nodes[1:]:
            right = (r["text"], (r["ids"], r["starts"], r["at"]))
            parts = (parts[0] + right[0], c.join(*parts, *right))
        row = (node["doc_id"], node["n"] // 2, node["size"], parts[0], *parts[1])
        return pa.Table.from_batches([_nodes([row])])

    long = rows.filter(F.length("text") > task)
    # Two rows of one id are told apart by the hash of their text until the end.
    long = checkpointed(long.withColumn("key", F.xxhash64("doc_id", "text")))
    result = spread(rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= task)).mapInArrow(short, schema)
    longest = long.agg(F.max(F.ceil(F.length("text") / task))).first()[0]
    if longest is None:
        return result
    cut = long.select("key", "text").mapInArrow(segments, "doc_id long, n long, size int, text string")
    level = checkpointed(cut.repartition(shuffle_partitions(documents.sparkSession)).mapInArrow(leaves, _NODE))
    while longest > 1:
        above = checkpointed(level.withColumn("pair", F.expr("n div 2")).groupBy("doc_id", "pair").applyInArrow(lambda k, g: joined(k, g.drop_columns(["pair"])), _NODE))
        discard(level)
        level, longest = above, (longest + 1) // 2
    value = F.size("ids").cast("long").alias("tokens") if counted else F.col("ids")
    whole = level.select(F.col("doc_id").alias("key"), value).join(long.select("key", "doc_id"), "key")
    return result.union(whole.select("doc_id", "tokens" if counted else "ids"))


def token_ids(documents: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}", task: int = 16 * LEAF) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have the empty list.

    Equal rows count once; rows of one id with several texts stay several rows.
    Texts up to ``task`` characters are halved and joined inside one task; longer
    ones are cut into segments of that size first, encoded in any task and joined
    pairwise up a tree. Nodes of the tree carry the text they stand for.
    """
    return _encoded(documents, path, task, counted=False)


def token_counts(texts: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}", task: int = 16 * LEAF) -> DataFrame:
    """(doc_id, tokens) of every row of documents; counted where they are encoded, so no ids travel."""
    return _encoded(texts, path, task, counted=True)
