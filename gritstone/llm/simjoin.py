"""Near-duplicate records with small edits: a chosen-path set similarity join.

A record is the set of its word shingles. Roots draw minwise tokens, and deeper nodes
branch on tokens they pick themselves, more than 1/similarity of them, so what two
records above the similarity share does not die out on the way down. The number of
root draws follows from a target recall at the deepest level. Nodes of few records
are compared exhaustively, larger ones branch again, and those that do not shrink
are compared in blocks. Pairs that survive a bit sketch are checked exactly.

Equal shingle sets form one class first: a text copied a million times takes part
once, and members come back only at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed, discard, spread

WORD = re.compile(r"[A-Za-z0-9_]+")
COORDINATES = 32  # minwise tokens a path can branch on
WORDS = 2  # 64-bit words of a sketch
SKETCH_BITS = 64 * WORDS
BITS = [f"bits{k}" for k in range(WORDS)]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1, 2**63, SKETCH_BITS, dtype=np.uint64)


@dataclass(frozen=True)
class JoinSettings:
    similarity: float = 0.8
    shingle: int = 5
    recall: float = 0.99  # of pairs at the similarity itself, were all nodes large down to the deepest level
    growth: float = 1.5  # children that a pair at the similarity shares of a shared node, on average
    leaf: int = 48  # nodes of so many records or fewer are compared exhaustively
    depth: int = 7  # nodes still larger at this depth are compared in blocks
    block: int = 2048
    sketch_sigmas: float = 4.2  # how far under its expectation an agreement may fall

    @property
    def branching(self) -> float:
        return self.growth / self.similarity

    @property
    def draws(self) -> int:
        return root_draws(self.similarity, self.branching, self.depth, self.recall)


def expected_recall(similarity: float, branching: float, depth: int, draws: int) -> float:
    """The share of pairs at the similarity that share a node of the last of ``depth`` levels.

    The tokens of a pair agree at a number of coordinates once for all trees, which
    is binomial; given it, draws agree by that share, and what is shared of a node
    is a branching process.
    """
    out = 0.0
    for m in range(COORDINATES + 1):
        p, dead = m / COORDINATES, 0.0
        for _ in range(depth - 1):
            child = 1 - p + p * dead
            dead = child ** int(branching) * (1 - branching % 1 + branching % 1 * child)
        out += comb(COORDINATES, m) * similarity**m * (1 - similarity) ** (COORDINATES - m) * (1 - (1 - p + p * dead) ** draws)
    return out


@cache
def root_draws(similarity: float, branching: float, depth: int, recall: float) -> int:
    """The fewest root draws with which the deepest level reaches the recall."""
    draws = 1
    while expected_recall(similarity, branching, depth, draws) < recall:
        draws += 1
        if draws > 8 * COORDINATES:
            raise ValueError(f"{COORDINATES} tokens cannot reach a recall of {recall} at depth {depth}")
    return draws


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of many texts at once."""

    def __init__(self, width: int):
        self.width, self.seen = width, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start of each text); a text of fewer words than a shingle has none."""
        seen, counts, numbers = self.seen, np.empty(len(texts), np.int64), []
        if len(seen) > 500_000:
            seen.clear()
        for k, text in enumerate(texts):
            words = " ".join(WORD.findall(text)).lower().split()
            counts[k] = len(words)
            try:
                numbers += [seen[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in seen:
                        seen[w] = xxhash.xxh64_intdigest(w)
                numbers += [seen[w] for w in words]
        w, width = np.array(numbers, np.uint64), self.width
        owner = np.repeat(np.arange(len(texts)), counts)
        if len(w) < width:
            return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        n = len(w) - width + 1
        with np.errstate(over="ignore"):
            h = np.zeros(n, np.uint64)
            for j in range(width):
                h = mix(h + w[j : n + j] * (np.uint64(2 * j + 1) * _GOLD)) if j else w[:n] * _GOLD
            h = mix(h)
        inside = owner[:n] == owner[width - 1 :]
        h, owner = h[inside], owner[:n][inside]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[keep], owner[keep]
        return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that together name a shingle set; every set must have a member."""
    at = starts[:-1]
    return np.add.reduceat(mix(h), at).view(np.int64), np.add.reduceat(mix(h ^ _GOLD), at).view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    width = rows.shape[1] * rows.dtype.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            h, starts = shingle(batch.column(1).to_pylist())
            full = np.flatnonzero(np.diff(starts))
            if not len(full):
                continue
            starts = np.append(starts[:-1][full], len(h))
            signature = np.empty((len(full), COORDINATES), np.uint32)
            bits = np.zeros((WORDS, len(full)), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(SKETCH_BITS):
                    low = np.minimum.reduceat(h * _ODD[j] + _ADD[j], starts[:-1])
                    if j < COORDINATES:
                        signature[:, j] = (mix(low) >> np.uint64(32)).astype(np.uint32)
                    bits[j // 64] |= (mix(low ^ _GOLD) >> np.uint64(63)) << np.uint64(j % 64)
                h1, h2 = set_keys(h, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), pa.array(h1), pa.array(h2), *[pa.array(b) for b in bits.view(np.int64)], _binary(signature)],
                ["id", "h1", "h2", *BITS, "signature"],
            )

    return run


def _branches(branching: float, draws: int | None):
    """Children of nodes. Rows are (node, n, sketch, signature); with a number of root draws they start there.

    Roots draw their tokens from one deck, so no two trees begin with the same one
    while the deck lasts. Deeper nodes draw by their own hash.
    """
    whole, part = divmod(branching, 1)
    deck = np.random.default_rng(7).permutation(COORDINATES)

    def children(node, at: np.ndarray, signature: np.ndarray, rows: np.ndarray) -> np.ndarray:
        token = signature[rows, at.astype(np.int64)].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
        return mix(node * _GOLD + mix(token)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, *bits = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("n", *BITS))
            raw = batch.column(batch.schema.get_field_index("signature"))
            signature = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, COORDINATES)
            every = np.arange(len(n))
            out: list[tuple] = []
            with np.errstate(over="ignore"):
                if draws is not None:
                    for draw in range(draws):
                        node = mix(np.full(len(n), draw // COORDINATES + 1, np.uint64) * _GOLD)
                        out.append((children(node, np.full(len(n), deck[draw % COORDINATES]), signature, every), n, *bits))
                else:
                    node = batch.column(0).to_numpy().view(np.uint64)
                    first = mix(node ^ np.uint64(0xA5A5)) % np.uint64(COORDINATES)
                    step = mix(node ^ np.uint64(0x5A5A)) % np.uint64(COORDINATES - 1) + np.uint64(1)
                    more = (mix(node ^ np.uint64(0xC3C3)) >> np.uint64(11)).astype(np.float64) / 2**53 < part
                    for t in range(int(whole) + 1):
                        rows = every if t < whole else np.flatnonzero(more)
                        at = (first[rows] + np.uint64(t) * step[rows]) % np.uint64(COORDINATES)
                        out.append((children(node[rows], at, signature, rows), n[rows], *[b[rows] for b in bits]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "n", *BITS])

    return run


def _agreeing(bits: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    apart = sum(np.bitwise_count((b[i] ^ b[j]).view(np.uint64)).astype(np.int64) for b in bits)
    return SKETCH_BITS - apart >= least


def _least_agreement(settings: JoinSettings) -> int:
    p = (1 + settings.similarity) / 2
    return int(SKETCH_BITS * p - settings.sketch_sigmas * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def _compare(settings: JoinSettings):
    """Over rows sorted by node: candidate pairs of small nodes (over false), members of large ones (over true)."""
    least = _least_agreement(settings)

    def small(node: np.ndarray, n: np.ndarray, *bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(node))
        for gap in range(1, settings.leaf):
            at = at[at + gap < len(node)]
            at = at[node[at] == node[at + gap]]
            if not len(at):
                return
            good = at[_agreeing(bits, at, at + gap, least)]
            if len(good):
                a, b = n[good], n[good + gap]
                yield _pairs(np.minimum(a, b), np.maximum(a, b), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.empty(0, np.int64)] * (2 + WORDS)
        held, large = none, None
        for batch in batches:
            node, n, *bits = (np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(held))
            if not len(node):
                continue
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            sizes = np.diff(np.append(starts, len(node)))
            over = np.repeat((sizes > settings.leaf) | (node[starts] == (node[0] if large is None else large)) & (large is not None), sizes)
            last = starts[-1]
            if over[last]:
                large, held = node[last], none
                cut = len(node)
            else:
                large, cut = None, last
                held = [x[cut:] for x in (node, n, *bits)]
            big = np.flatnonzero(over[:cut])
            if len(big):
                yield _pairs(node[big], n[big], True)
            few = np.flatnonzero(~over[:cut])
            yield from small(node[few], n[few], *[b[few] for b in bits])
        yield from small(*held)

    return run


def _pairs(a: np.ndarray, b: np.ndarray, over: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], ["a", "b", "over"])


def _in_blocks(members: DataFrame, settings: JoinSettings) -> DataFrame:
    """All candidate pairs of nodes that do not shrink: (node, n, bits) against itself, one pair of blocks a task group."""
    least = _least_agreement(settings)
    sizes = members.groupBy("node").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"))
    placed = members.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    copies = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    copies = copies.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", *BITS)

    def run(key, group):
        own, n, *bits = (group.column(c).to_numpy() for c in ("own", "n", *BITS))
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for k in left:
            other = right[n[right] > n[k]] if i == j else right
            good = other[_agreeing(bits, np.full(len(other), k), other, least)]
            a.append(np.minimum(n[k], n[good]))
            b.append(np.maximum(n[k], n[good]))
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate(a or [empty]), "b": np.concatenate(b or [empty])})

    return copies.groupBy("node", "i", "j").applyInArrow(run, "a long, b long")


def candidate_classes(classes: DataFrame, settings: JoinSettings) -> DataFrame:
    """Distinct pairs (a, b), a < b, of class numbers that share a small node of a tree and agree in sketch; checkpointed."""
    sketch = ", ".join(f"{b} long" for b in BITS)
    node_schema, pair_schema = f"node long, n long, {sketch}", "a long, b long, over boolean"
    rows = classes.select("n", *BITS, "signature").mapInArrow(_branches(settings.branching, settings.draws), node_schema)
    found: list[DataFrame] = []
    levels: list[DataFrame] = []
    for depth in range(settings.depth):
        compared = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_compare(settings), pair_schema)
        compared = checkpointed(compared)
        levels.append(compared)
        found.append(compared.filter("not over").select("a", "b"))
        large = compared.filter("over").select(F.col("a").alias("node"), F.col("b").alias("n"))
        if large.isEmpty():
            break
        if depth == settings.depth - 1:
            found.append(_in_blocks(large.join(classes.select("n", *BITS), "n").select("node", "n", *BITS), settings))
            break
        rows = large.join(classes.select("n", *BITS, "signature"), "n").select("node", "n", *BITS, "signature")
        rows = rows.mapInArrow(_branches(settings.branching, None), node_schema)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = checkpointed(out.distinct())
    for level in levels:
        discard(level)
    return out


def _grams(width: int):
    """Sorted shingle hashes of the texts that still have the keys of their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            h, starts = shingle(batch.column(0).to_pylist())
            full = np.flatnonzero(np.diff(starts))
            if not len(full):
                continue
            ends = starts[1:][full]
            starts = np.append(starts[:-1][full], len(h))
            with np.errstate(over="ignore"):
                h1, h2 = set_keys(h, starts)
            same = (h1 == batch.column(2).to_numpy()[full]) & (h2 == batch.column(3).to_numpy()[full])
            rows = pa.array(full[same])
            grams = [h[a:b].tobytes() for a, b, ok in zip(starts[:-1], ends, same, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(4).take(rows), pa.array(grams, pa.binary())], ["n", "rep", "grams"])

    return run


def _exact(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                out.append(both / (len(u) + len(v) - both))
            out = np.array(out, np.float64)
            keep = pa.array(out >= similarity)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(keep) for k in range(4)], pa.array(out[out >= similarity])], ["a", "b", "a_rep", "b_rep", "jaccard"])

    return run


def similarity_join(records: DataFrame, settings: JoinSettings = JoinSettings()) -> tuple[DataFrame, DataFrame]:
    """Links between classes and the members of classes of ``records`` (id, text).

    Returns ``links`` (a, b, a_rep, b_rep, jaccard), a < b by number, of classes
    whose shingle sets have at least the similarity, with the smallest id of each,
    and ``members`` (n, id) of the classes of two ids and more. Records with a null
    id or text, or too short for one shingle, belong to no class. Repeated rows
    count once; an id with several texts is a member of several classes. Other
    columns are ignored.
    """
    clean = records.select("id", "text").filter("id is not null and text is not null")
    schema = f"id string, h1 long, h2 long, {', '.join(f'{b} long' for b in BITS)}, signature binary"
    sketched = checkpointed(spread(clean).mapInArrow(_sketches(settings.shingle), schema))
    classes = sketched.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), *[F.first(c).alias(c) for c in (*BITS, "signature")])
    classes = checkpointed(classes.withColumn("n", F.monotonically_increasing_id()))
    pairs = candidate_classes(classes, settings)
    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    wanted = classes.select("n", F.col("rep").alias("id"), "h1", "h2").join(wanted, "n", "left_semi")
    grams = clean.join(wanted, "id").select("text", "n", "h1", "h2", F.col("id").alias("rep")).mapInArrow(_grams(settings.shingle), "n long, rep string, grams binary")
    grams = checkpointed(grams.dropDuplicates(["n"]))
    left, right = (grams.select(F.col("n").alias(x), F.col("rep").alias(f"{x}_rep"), F.col("grams").alias(f"g{x}")) for x in "ab")
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "a_rep", "b_rep", "ga", "gb")
    links = links.mapInArrow(_exact(settings.similarity), "a long, b long, a_rep string, b_rep string, jaccard double")
    several = classes.filter("last <> rep").select("h1", "h2", "n")
    members = sketched.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("n", "id").distinct()
    return links, members


FUNCTIONS = JoinSettings(similarity=0.6, shingle=3)
MIN_TOKENS = 40


def found_pairs(functions: DataFrame, settings: JoinSettings = FUNCTIONS) -> DataFrame:
    """(a_id, b_id), a_id < b_id, of functions of enough tokens whose sets of word triples are alike.

    The result holds each pair, so members of linked classes and of one class are
    joined on the class at the very end.
    """
    long = functions.filter(F.size("toks") >= MIN_TOKENS).select("id", F.col("source").alias("text"))
    links, members = similarity_join(long, settings)
    members = checkpointed(members)
    left, right = members.toDF("a", "a_id"), members.toDF("b", "b_id")
    across = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a_id", "a_rep").alias("x"), F.coalesce("b_id", "b_rep").alias("y"))
    within = left.join(right, (F.col("a") == F.col("b")) & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id")
    ordered = across.filter("x <> y").select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    return ordered.union(within).distinct()


def linked_classes(functions: DataFrame, settings: JoinSettings = FUNCTIONS) -> DataFrame:
    """(id, class_id, links) of functions of enough tokens that have a copy or a near copy: the form of the result for any number of copies.

    Functions of one set of word runs are one class, named by its smallest id;
    ``links`` counts the other classes alike enough. A text copied a million times
    is a million rows, not their pairs; no link between different texts is lost.
    """
    long = functions.filter(F.size("toks") >= MIN_TOKENS).select("id", F.col("source").alias("text"))
    links, members = similarity_join(long, settings)
    links, members = checkpointed(links), checkpointed(members)
    ends = links.select(F.col("a").alias("n"), F.col("a_rep").alias("rep")).union(links.select("b", "b_rep"))
    degrees = ends.groupBy("n").agg(F.min("rep").alias("rep"), F.count("*").alias("links"))
    reps = members.groupBy("n").agg(F.min("id").alias("class_id"))
    copied = members.join(reps, "n").join(degrees.select("n", "links"), "n", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    alone = degrees.join(reps, "n", "left_anti").select(F.col("rep").alias("id"), F.col("rep").alias("class_id"), "links")
    return copied.union(alone)
