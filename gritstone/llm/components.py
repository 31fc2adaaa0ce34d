"""Consolidating pairwise matches into groups.

A round hooks every head to its smallest neighbour (minimum-label propagation over
the edges) and jumps pointers until no label changes; edges then lead from head to
head, and those inside a group are dropped, so settled groups cost nothing any more.
Every round is written to the shared folder; the loop ends when no edge is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.operators.keyed import answered_by
from gritstone.session import discard, written

MAX_ROUNDS = 200


def linked_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v, of the rows of candidate pairs that link two ids.

    Rows whose match is false or null, self pairs and rows with a null id link
    nothing; an empty string is an id like any other; repeated, turned-round and
    contradicting rows count once when any of them is true.
    """
    return (
        pairs.filter(F.col("structural_match") & (F.col("a_id") != F.col("b_id")))
        .select(F.least("a_id", "b_id").alias("u"), F.greatest("a_id", "b_id").alias("v"))
        .distinct()
    )


def mapped(rows: DataFrame, key: str, pointers: DataFrame) -> DataFrame:
    """``rows``, a table, with every ``key`` replaced by what ``pointers`` (key, to) say; a key without one stays.

    A hub is spread over salts, so it is never one task's work.
    """
    known = pointers.select(F.col("key").alias(key), F.col("to").alias("_to"))
    return answered_by(rows, known, key).withColumn(key, F.coalesce("_to", key)).select(rows.columns)


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers (key, to), written, to the ends of their paths: everybody takes the pointer of whom they point to, until none changes.

    Pointers only ever fall, so their sum tells whether one did.
    """
    total = F.sum(F.col("to").cast("decimal(38,0)"))
    before = pointers.agg(total).first()[0]
    for _ in range(MAX_ROUNDS):
        step = written(mapped(pointers, "to", pointers))
        discard(pointers)
        pointers, after = step, step.agg(total).first()[0]
        if after == before:
            return pointers
        before = after
    raise RuntimeError(f"pointers still change after {MAX_ROUNDS} jumps")


def connected_groups(links: DataFrame) -> DataFrame:
    """(id, group_id) of every id in ``links`` (u, v); group_id is the smallest id linked to it.

    Ids are numbered in their order first, so a round moves pairs of integers.
    Neighbours of a hub (an id on a third of all links) meet in a partially
    aggregated minimum only. An empty table gives an empty result.
    """
    links = written(links)
    names = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    # The order of the numbers is the order of the ids: range partitions, then positions in them.
    names = written(names.orderBy("id").withColumn("n", F.monotonically_increasing_id()))
    number = names.select(F.col("id").alias("key"), F.col("n").cast("string").alias("to"))
    half = written(mapped(links, "u", number))
    discard(links)
    edges = written(mapped(half, "v", number).select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b")))
    discard(half)
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        both = edges.select(F.col("a").alias("key"), F.col("b").alias("m")).union(edges.select("b", "a"))
        heads = both.groupBy("key").agg(F.min("m").alias("m")).select("key", F.least("key", "m").alias("to"))
        rounds.append(_jumped(written(heads)))
        half = written(mapped(edges, "a", rounds[-1]))
        discard(edges)
        ends = mapped(half, "b", rounds[-1]).filter("a <> b")
        edges = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(half)
    if not rounds:
        return names.select("id", F.col("id").alias("group_id")).limit(0)
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        labels = written(mapped(earlier, "to", labels))
    named = labels.join(names, F.col("key") == F.col("n")).select("id", F.col("to").cast("string").alias("group_id"))
    heads = names.select(F.col("n").cast("string").alias("key"), F.col("id").alias("to"))
    return mapped(written(named), "group_id", heads)


def found_groups(pairs: DataFrame) -> DataFrame:
    return connected_groups(linked_pairs(pairs))
