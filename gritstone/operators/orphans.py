"""References to records that do not exist, or not yet, or no longer.

Keys are dictionary-encoded as integers, one code for every stretch of time over
which a key is steadily present or absent; until they have a code, paths travel as
hashes of 96 bits. Compressed bitmaps per key range and
period hold the codes that are referenced; bitmaps per key range hold the codes of
present parents. Reference AND-NOT parent leaves the dangling codes, which are
decoded back to the rows that made the reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import checkpointed, shuffle_partitions

RANGE_BITS = 32768  # codes in a key range, the width of Spark's bitmap buckets
SPARSE = 1024  # bitmaps of fewer bits are kept as lists of positions
EARLIEST = -(2**62)
LATEST = 2**62

# Endings an import may leave out, and the endings tools write for each source ending.
ENDINGS = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")
WRITTEN_FOR = {"ts": ["js"], "tsx": ["js", "jsx"], "mts": ["mjs"], "cts": ["cjs"]}


def normal_path(path: Column) -> Column:
    """A stored path with slashes for backslashes and without a leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def joined_path(base: Column, relative: Column) -> Column:
    """``relative`` joined to the folder of ``base``; steps above the root stay in the result."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, relative), "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def specifiers_of(path: Column) -> Column:
    """All normalised specifiers that a file at ``path`` answers, the path itself included."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    stem = F.regexp_replace(path, r"\.[^./]+$", "")
    known = ending.isin(*ENDINGS)
    out = [path, F.when(known, stem), F.when(known & (F.regexp_extract(stem, "([^/]*)$", 1) == "index"), F.regexp_replace(stem, "/?index$", ""))]
    for source, written in WRITTEN_FOR.items():
        out += [F.when(ending == source, F.concat(stem, F.lit(f".{w}"))) for w in written]
    return F.array_distinct(F.array_compact(F.array(*out)))


def _key(kind: str, path: Column) -> list[Column]:
    """A 96-bit key of a path (kind f) or of a specifier (kind p)."""
    text = F.concat(F.lit(kind), path)
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def import_references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, k1, k2, t) of every reference: t in microseconds.

    A row without seen_at, and a side without a path, makes no reference. Doubled
    rows make doubled references.
    """
    e = edges.filter("seen_at is not null and edge_id is not null").select(
        "edge_id", F.unix_micros(F.col("seen_at").cast("timestamp")).alias("t"), normal_path(F.col("from_rel")).alias("source"), normal_path(F.col("to_rel")).alias("target"), "specifier"
    )
    near = F.col("target").isNull() & F.col("specifier").rlike(r"^\.\.?/") & F.col("source").isNotNull()
    sides = F.array(
        F.when(F.col("source").isNotNull(), F.struct(F.lit("from").alias("side"), *_key("f", F.col("source")))),
        F.when(F.col("target").isNotNull(), F.struct(F.lit("to").alias("side"), *_key("f", F.col("target")))).when(
            near, F.struct(F.lit("to").alias("side"), *_key("p", joined_path(F.col("source"), F.col("specifier"))))
        ),
    )
    return e.select("edge_id", "t", F.explode(F.array_compact(sides)).alias("r")).select("edge_id", "t", "r.*")


def _by_month(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key and month with the sorted set of (t, value); bounded by the seconds of a month."""
    month = F.floor(F.col("t") / (30 * 86_400_000_000)).alias("month")
    return events.groupBy(*keys, month).agg(F.array_sort(F.collect_set(F.struct("t", value))).alias("steps"))


def file_changes(files: DataFrame, removed: DataFrame) -> DataFrame:
    """(rel, t, delta): +1 when a file appears, -1 when it goes away.

    Of an indexing and a removal at the same second the indexing counts. Rows
    without a path or a time tell nothing. A path with very many rows is split by
    month before anything is gathered; only one state per month is carried on.
    """
    seen = files.select(normal_path(F.col("rel")).alias("rel"), (F.col("indexed_at") * 1_000_000).alias("t"), F.lit(1).alias("here"))
    gone = removed.select(normal_path(F.col("rel")).alias("rel"), (F.col("removed_at") * 1_000_000).alias("t"), F.lit(0).alias("here"))
    months = _by_month(seen.union(gone).dropna(subset=["rel", "t"]), ["rel"], "here")
    before = F.lag(F.col("steps")[F.size("steps") - 1]["here"]).over(Window.partitionBy("rel").orderBy("month"))
    months = months.withColumn("before", F.coalesce(before, F.lit(0)))
    # Equal times are sorted by state, so the last of a time stands for it.
    last = F.filter("steps", lambda s, i: F.coalesce(F.try_element_at("steps", (i + 2).cast("int"))["t"] != s["t"], F.lit(True)))
    months = months.withColumn("steps", last)
    was = lambda i: F.when(i == 0, F.col("before")).otherwise(F.try_element_at("steps", F.greatest(i, F.lit(1)).cast("int"))["here"])
    deltas = F.transform("steps", lambda s, i: F.struct(s["t"].alias("t"), (s["here"] - was(i)).alias("delta")))
    return months.select("rel", F.explode(F.filter(deltas, lambda d: d["delta"] != 0)).alias("d")).select("rel", "d.t", "d.delta")


def presence(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, t_from, t_to, present) over all time of every wanted key (k1, k2)."""
    direct = changes.select(*_key("f", F.col("rel")), "t", F.lit("").alias("rel"), "delta")
    answers = changes.select(F.explode(specifiers_of(F.col("rel"))).alias("p"), "t", "rel", "delta")
    answers = answers.select(*_key("p", F.col("p")), "t", "rel", "delta")
    moves = direct.union(answers).join(wanted, ["k1", "k2"], "left_semi")
    months = _by_month(moves.groupBy("k1", "k2", "t").agg(F.sum("delta").alias("delta")), ["k1", "k2"], "delta")
    w = Window.partitionBy("k1", "k2").orderBy("month")
    total = F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, s: a + s["delta"])
    months = months.withColumn("total", total)
    months = months.withColumn("before", F.coalesce(F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    months = months.withColumn("until", F.coalesce(F.lead(F.col("steps")[0]["t"]).over(w), F.lit(LATEST))).withColumn("first", F.row_number().over(w) == 1)
    upto = lambda i: F.aggregate(F.slice("steps", F.lit(1), (i + 1).cast("int")), F.col("before"), lambda a, s: a + s["delta"])
    spans = F.transform(
        "steps",
        lambda s, i: F.struct(s["t"].alias("t_from"), F.coalesce(F.try_element_at("steps", (i + 2).cast("int"))["t"], F.col("until")).alias("t_to"), (upto(i) > 0).alias("present")),
    )
    start = F.when(F.col("first"), F.array(F.struct(F.lit(EARLIEST).alias("t_from"), F.col("steps")[0]["t"].alias("t_to"), F.lit(False).alias("present"))))
    spans = F.concat(F.coalesce(start, F.slice(spans, 1, 0)), spans)
    known = months.select("k1", "k2", F.explode(spans).alias("s")).select("k1", "k2", "s.*")
    return wanted.join(known, ["k1", "k2"], "left").select(
        "k1", "k2", F.coalesce("t_from", F.lit(EARLIEST)).alias("t_from"), F.coalesce("t_to", F.lit(LATEST)).alias("t_to"), F.coalesce("present", F.lit(False)).alias("present")
    )


def compress(bits: bytes) -> bytes:
    """A key range's bitmap: positions when few bits are set, else the bits."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    return b"s" + at.astype(np.uint16).tobytes() if len(at) < SPARSE else b"d" + bits


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("bits")
        yield batch.set_column(at, "bits", pa.array([compress(b) for b in batch.column(at).to_pylist()], pa.binary()))


def expand(packed: bytes | None) -> np.ndarray:
    """The flags of a compressed bitmap; None is an empty one."""
    flags = np.zeros(RANGE_BITS, bool)
    if packed is not None and packed[:1] == b"s":
        flags[np.frombuffer(packed[1:], np.uint16)] = True
    elif packed is not None:
        flags[:] = np.unpackbits(np.frombuffer(packed[1:], np.uint8), bitorder="little")
    return flags


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        periods, ranges, refs, parents = (batch.column(i).to_pylist() for i in range(4))
        for period, k, ref, parent in zip(periods, ranges, refs, parents, strict=True):
            left = np.flatnonzero(expand(ref) & ~expand(parent))
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), period, np.int32)), pa.array(left + k * RANGE_BITS)], ["period", "code"])


def dangling(refs: DataFrame, changes: DataFrame) -> DataFrame:
    """(edge_id, side, t, dangling) for every reference; a key that is not there at t dangles.

    Hot keys: references are counted per key first (partial sums before the
    shuffle). Keys above a fixed share of all references, at most four times as
    many as there are shuffle partitions, are spread over salts, and only their
    spans are repeated.
    """
    width = shuffle_partitions(refs.sparkSession)
    counts = checkpointed(refs.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    share = F.lit(4 * width)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    hot = counts.join(F.broadcast(total), F.col("n") * share > F.col("all")).filter("n > 1000")
    hot = checkpointed(hot.select("k1", "k2", F.least(F.lit(width), F.ceil(F.col("n") * share / F.col("all"))).cast("int").alias("salts")))
    spans = presence(changes, counts.select("k1", "k2"))
    spans = checkpointed(spans.repartitionByRange(width, "k1", "k2", "t_from").withColumn("code", F.monotonically_increasing_id()))
    period = F.trunc(F.timestamp_micros("t"), "MM")
    salted = refs.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("edge_id"), "salts"), F.lit(0)))
    copies = spans.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    copies = copies.select("k1", "k2", F.col("salt").cast("long"), "t_from", "t_to", "code")
    coded = salted.join(copies, ["k1", "k2", "salt"]).filter("t >= t_from and t < t_to")
    coded = checkpointed(coded.select("edge_id", "side", "code", F.unix_date(period).alias("period"), "t"))
    in_range = [F.expr(f"code div {RANGE_BITS}").alias("range"), F.pmod("code", F.lit(RANGE_BITS)).alias("at")]
    packed = "range long, bits binary"
    refs_map = coded.select("period", "code").distinct().select("period", *in_range).groupBy("period", "range").agg(F.bitmap_construct_agg("at").alias("bits"))
    refs_map = refs_map.mapInArrow(_compressed, f"period int, {packed}")
    parents = spans.filter("present").select(*in_range).groupBy("range").agg(F.bitmap_construct_agg("at").alias("bits"))
    parents = parents.mapInArrow(_compressed, packed).withColumnRenamed("bits", "parent")
    left = refs_map.join(parents, "range", "left").select("period", "range", "bits", "parent").mapInArrow(_and_not, "period int, code long")
    left = left.withColumn("hit", F.lit(True))
    return coded.join(left, ["period", "code"], "left").select("edge_id", "side", "t", F.col("hit").isNotNull().alias("dangling"))


def dangling_imports(edges: DataFrame, files: DataFrame, removed: DataFrame) -> DataFrame:
    """(edge_id, side) of every reference of an edge whose file is not present at seen_at."""
    out = dangling(import_references(edges), file_changes(files, removed))
    return out.filter("dangling").select("edge_id", "side").distinct()


def dangling_rates(edges: DataFrame, files: DataFrame, removed: DataFrame) -> DataFrame:
    """References and dangling ones per referring column and month of seen_at; doubled rows count once."""
    out = dangling(import_references(edges), file_changes(files, removed)).distinct()
    month = F.date_format(F.timestamp_micros("t"), "yyyy-MM")
    return out.groupBy(F.concat(F.lit("edges."), "side", F.lit("_rel")).alias("referrer"), month.alias("month")).agg(
        F.count("*").alias("refs"), F.count_if("dangling").alias("dangling")
    )
