"""Mixing sources to target weights.

Every record of a source gets the same number of copies, a real number that gives
the source its share of the tokens. Its fraction is rounded by a pivotal scheme
weighted by size: two open records pass token mass between them until one of them
is integral, so the tokens of a source stay put. Buckets round their own records
in parallel and pass one open record each up a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.llm.tokens import BYTE_BPE, TOKENIZERS, token_counts
from gritstone.session import checkpointed, shuffle_partitions

LARGE = 500  # a record is large above a 500th of its source, so a source has fewer large ones than that
FAN = 16  # open records joined in one step of the tree
SEED = 20240601
_EPS = 1e-9


def source_name(source: Column) -> Column:
    """Spellings that differ in case or outer blanks are one source."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, weight, max_repeats, tokens, docs, rate) per source of ``targets``.

    ``rate`` is the number of copies of each record. Without a ``total`` the mixture
    is the largest in which no source needs more than its repeats; with one, sources
    that cannot fill their share give all they may and the reports show it.
    """
    wanted = targets.filter("source is not null and weight > 0 and max_repeats > 0").groupBy(source_name(F.col("source")).alias("source"))
    wanted = wanted.agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = wanted.join(have, "source", "left").fillna(0, ["tokens", "docs"])
    able = rows.filter("tokens > 0")
    shares = able.agg(F.sum("weight").alias("sum")).first()[0]
    if not shares:
        return rows.withColumn("share", F.lit(0.0)).withColumn("rate", F.lit(0.0))
    share = F.col("weight") / shares
    if total is None:
        total = able.agg(F.min(F.col("tokens") * F.col("max_repeats") / share)).first()[0]
    rate = F.least(share * F.lit(float(total)) / F.col("tokens"), F.col("max_repeats").cast("double"))
    empty = F.col("tokens") == 0
    return rows.withColumn("share", F.when(empty, 0.0).otherwise(share)).withColumn("rate", F.when(empty, 0.0).otherwise(rate))


def _coin(seed: int, a: int, b: int) -> float:
    return xxhash.xxh64_intdigest(f"{seed}:{a}:{b}") / 2**64


def pivot(ids: np.ndarray, sizes: np.ndarray, open_: np.ndarray, seed: int) -> tuple[np.ndarray, int | None]:
    """Round fractions so that the sum of size times fraction stays; at most one stays open.

    Of two open records one gains what the other loses, in tokens; which way is a
    coin weighted so that each record's expectation stays.
    """
    f = open_.astype(float).copy()
    held: int | None = None
    for k in range(len(f)):
        if f[k] <= _EPS or f[k] >= 1 - _EPS:
            f[k] = round(f[k])
            continue
        if held is None:
            held = k
            continue
        i, j = held, k
        up = min((1 - f[i]) * sizes[i], f[j] * sizes[j])  # tokens i can take from j
        down = min(f[i] * sizes[i], (1 - f[j]) * sizes[j])
        gain = up if _coin(seed, int(ids[i]), int(ids[j])) < down / (up + down) else -down
        f[i] += gain / sizes[i]
        f[j] -= gain / sizes[j]
        held = None
        for x in (i, j):
            if _EPS < f[x] < 1 - _EPS:
                held = x
            else:
                f[x] = round(f[x])
    return f, held


_STATE = "source string, bucket long, doc_id long, tokens long, whole long, fraction double"


def _round_group(final: bool, seed: int):
    def run(key, group):
        # Large records first: what is left open at the end is small then.
        group = group.sort_by([("tokens", "descending"), ("doc_id", "ascending")])
        ids, sizes, f = (group.column(c).to_numpy() for c in ("doc_id", "tokens", "fraction"))
        done, held = pivot(ids, sizes, f, seed)
        if final and held is not None:
            done[held] = float(_coin(seed, int(ids[held]), -1) < done[held])
        at = group.schema.get_field_index("fraction")
        return group.set_column(at, "fraction", pa.array(done, pa.float64()))

    return run


def mixture(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies) of every record drawn at least once.

    ``sizes`` is (doc_id, source, tokens). Records without tokens, without a source
    or of a source without a target are not drawn; no record is drawn more often
    than max_repeats says. Large records, of which a source has a bounded number,
    are rounded first; the rate of the others makes up for what those got too much
    or too little. Buckets of a source hold about as many records each,
    however large it is; their number follows the row count.
    """
    sizes = checkpointed(sizes.filter("source is not null and tokens > 0"))
    # One row per source of targets.
    rates = checkpointed(plan(sizes, targets, total).filter("rate > 0").select("source", "rate", "max_repeats", F.col("tokens").alias("all")))
    rows = sizes.join(F.broadcast(rates.select("source", "rate", "all")), "source")
    is_large = F.col("tokens") * LARGE > F.col("all")
    whole = F.floor(F.col("rate") + _EPS)
    parts = [whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("fraction")]
    large = rows.filter(is_large).select("source", F.lit(0).cast("long").alias("bucket"), "doc_id", "tokens", *parts)
    large = checkpointed(large.groupBy("source").applyInArrow(_round_group(True, seed), _STATE))
    got = large.groupBy("source").agg(F.sum(F.col("tokens") * (F.col("whole") + F.col("fraction"))).alias("got"), F.sum("tokens").alias("big"))
    left = rates.join(F.broadcast(got), "source", "left").fillna(0, ["got", "big"])
    rest = F.least(F.greatest((F.col("rate") * F.col("all") - F.col("got")) / (F.col("all") - F.col("big")), F.lit(0.0)), F.col("max_repeats").cast("double"))
    left = left.filter(F.col("all") > F.col("big")).select("source", "all", rest.alias("rate"))
    rows = sizes.join(F.broadcast(left), "source").filter(~is_large)
    per_bucket = 20_000
    buckets = max(shuffle_partitions(sizes.sparkSession), sizes.count() // per_bucket + 1)
    rows = rows.select(
        "source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)).alias("bucket"), "doc_id", "tokens", *parts
    )
    is_open = (F.col("fraction") > _EPS) & (F.col("fraction") < 1 - _EPS)
    settled = [large]
    level, size = rows, buckets
    while True:
        final = size == 1
        level = checkpointed(level.groupBy("source", "bucket").applyInArrow(_round_group(final, seed), _STATE))
        settled.append(level.filter(~is_open))
        if final:
            break
        level = level.filter(is_open).withColumn("bucket", F.expr(f"bucket div {FAN}"))
        size = -(-size // FAN)
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    copies = (F.col("whole") + F.round("fraction").cast("long")).alias("copies")
    return out.select("doc_id", "source", "tokens", copies).filter("copies > 0")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of targets: records and tokens there and drawn, target share and the share reached."""
    wanted = plan(sizes.filter("source is not null and tokens > 0"), targets, total)
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    rows = wanted.join(got, "source", "left").fillna(0, ["drawn_tokens", "copies", "most_copies"])
    every = got.agg(F.sum("drawn_tokens").alias("every"))
    rows = rows.join(F.broadcast(every))
    reached = F.when(F.col("every") > 0, F.col("drawn_tokens") / F.col("every")).otherwise(F.lit(0.0))
    return rows.select(
        "source", F.col("docs").alias("source_docs"), F.col("tokens").alias("source_tokens"), "max_repeats", F.round("share", 9).alias("target_share"), F.round(reached, 9).alias("reached_share"), "drawn_tokens", "copies", "most_copies"
    )


def document_sizes(documents: DataFrame, path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, source, tokens), one row per document; null and empty texts have no tokens.

    Of several rows of one id the one with the most tokens counts.
    """
    counts = token_counts(documents, path).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    sources = documents.groupBy("doc_id").agg(F.min(source_name(F.col("source"))).alias("source"))
    return counts.join(sources, "doc_id").select("doc_id", "source", "tokens")
