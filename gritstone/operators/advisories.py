"""Package versions against advisory ranges, and families of advisory aliases."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.scalar import python_name
from gritstone.functions.versions import pep440_key, semver_key, staged_key
from gritstone.session import checkpointed, shuffle_partitions

HOT_HITS = 100_000  # a name of fewer hits is never hot

# Kinds of range events in the order they are read at one version.
KINDS = ("introduced", "fixed", "last_affected")


def range_state(version_key: Column, events: Column) -> Column:
    """Walk a range's events (key, kind, version) in version order for one version.

    Gives struct(holds, fix). An introduced event opens an interval; a fixed one
    closes it before its version, a last_affected one after it. An interval left
    open runs on. A null key anywhere leaves the range unreadable: a null result.
    """
    order = F.array_sort(F.transform(events, lambda e: F.struct(e["key"].alias("key"), F.array_position(F.array(*map(F.lit, KINDS)), e["kind"]).alias("kind"), e["version"].alias("version"))))
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("holds"), F.lit(None).cast("string").alias("fix"))

    def step(s: Column, e: Column) -> Column:
        starts = e["kind"] == 1
        fixed = s["open"] & (e["kind"] == 2) & (version_key < e["key"])
        last = s["open"] & (e["kind"] == 3) & (version_key <= e["key"])
        return F.when(s["holds"], s).otherwise(
            F.struct(F.when(starts, version_key >= e["key"]).otherwise(F.lit(False)).alias("open"), (fixed | last).alias("holds"), F.when(fixed, e["version"]).alias("fix"))
        )

    result = F.aggregate(order, start, step, lambda w: F.struct((w["holds"] | w["open"]).alias("holds"), w["fix"].alias("fix")))
    readable = version_key.isNotNull() & F.forall(events, lambda e: e["key"].isNotNull())
    return F.when(readable, result)


def affected(packages: DataFrame, advisories: DataFrame, key, on: list[str]) -> DataFrame:
    """Packages with each advisory whose range holds their version, and the fix it names.

    ``advisories`` has the columns ``on``, ``advisory`` and ``events``
    (array of (kind, version)); ``key`` turns a version into a sort key.
    """
    keyed = F.transform("events", lambda e: F.struct(key(e["version"]).alias("key"), e["kind"].alias("kind"), e["version"].alias("version")))
    rows = packages.join(advisories.withColumn("events", keyed), on)
    rows = rows.withColumn("state", range_state(key(F.col("version")), F.col("events")))
    return rows.filter("state.holds").withColumn("fix", F.col("state.fix")).drop("state", "events")


# Ecosystems whose own ranges have an order of their own; ranges of semantic versions are read everywhere.
ORDERED = {"npm": None, "PyPI": pep440_key, "Packagist": staged_key}


def _keyed(events: Column, key) -> Column:
    return F.transform(events, lambda e: F.struct(key(e["version"]).alias("key"), e["kind"].alias("kind"), e["version"].alias("version")))


def _judged(rows: DataFrame, says) -> DataFrame:
    """``rows`` (_r, ranges, ...) with fix_kind and fix; ``says`` is the state of one range in _r."""
    rows = rows.withColumn("_s", F.transform("_r", says))
    rows = rows.withColumn("_h", F.filter("_s", lambda s: F.coalesce(s["holds"], F.lit(False))))
    fix = F.try_element_at("_h", F.lit(1))["fix"]
    kind = F.when(F.col("ranges").isNull(), "none").when(F.size("_h") > 0, F.when(fix.isNotNull(), "named").otherwise("none")).when(F.exists("_s", lambda s: s.isNull()), "unreadable").otherwise("outside")
    return rows.withColumn("fix_kind", kind).withColumn("fix", fix).drop("_r", "_s", "_h")


def with_fix(rows: DataFrame, ecosystem: str) -> DataFrame:
    """``rows`` (version, ranges, ...) of one ecosystem with what the ranges say: fix_kind and fix.

    ``ranges`` is an array of (type, events of (kind, version)). The first range
    that holds the version names the fix (named) or names none (none); else
    unreadable where one could not be ordered, outside where all could. Ranges
    of commits, of an ecosystem without an order and with a version that is none
    cannot be ordered. Null ranges are none.
    """
    own = ORDERED.get(ecosystem)
    # Keys are columns of their own: inside a lambda they would be worked out for every event.
    rows = rows.withColumn("_vs", semver_key(F.col("version")))
    rows = rows.withColumn("_vo", own(F.col("version")) if own else F.lit(None).cast("int"))
    ranges = F.transform("ranges", lambda r: F.struct(F.when(r["type"] == "SEMVER", _keyed(r["events"], semver_key)).alias("semver"), (F.when(r["type"] == "ECOSYSTEM", _keyed(r["events"], own)) if own else F.lit(None).cast("int")).alias("own")))
    says = lambda r: F.coalesce(range_state(F.col("_vs"), r["semver"]), range_state(F.col("_vo"), r["own"])) if own else range_state(F.col("_vs"), r["semver"])
    return _judged(rows.withColumn("_r", ranges), says).drop("_vs", "_vo")


def _own_key(ecosystem: Column, version: Column) -> Column:
    """The keys of all ecosystems with an order side by side, one of them set; none is where there is no order or no version."""
    return F.struct(*[F.when(ecosystem == name, key(version)).alias(name) for name, key in ORDERED.items() if key])


def _no_own(key: Column) -> Column:
    return reduce(and_, [key[name].isNull() for name, order in ORDERED.items() if order])


def _point(key: Column, side: int) -> Column:
    """A place in the order of keys: just before a key (0), at it (1) or just after it (2)."""
    return F.struct(key.alias("key"), F.lit(side).alias("side"))


def _stretches(rows: DataFrame) -> DataFrame:
    """``rows`` (ecosystem, ranges, ...) once for each stretch of versions of which their ranges say the same.

    Adds fix_kind, fix and the bounds of the stretch in both orders (_semver_from,
    _semver_to, _own_from, _own_to; null is no bound, from is inside). What ranges
    say changes only before a version that introduces or fixes and after one that
    is last affected. So versions are numbered by the bounds below them, events
    likewise, and each number is judged once, however many packages there are.
    Versions that are none come before all others.
    """
    ecosystem = F.col("ecosystem")

    def own(version: Column) -> Column:
        key = _own_key(ecosystem, version)
        return F.when(~_no_own(key), key)

    keyed = lambda r, kind, key: F.when(r["type"] == kind, _keyed(r["events"], key))
    rows = rows.withColumn("_r", F.transform("ranges", lambda r: F.struct(keyed(r, "SEMVER", semver_key).alias("semver"), keyed(r, "ECOSYSTEM", own).alias("own"))))
    last = lambda e: F.coalesce(e["kind"] == "last_affected", F.lit(False))
    bound = lambda e: F.struct(e["key"].alias("key"), F.when(last(e), 2).otherwise(0).alias("side"))
    lowest = {"semver": _point(semver_key(F.lit(None).cast("string")), 2), "own": _point(_own_key(F.lit(None).cast("string"), F.lit(None).cast("string")), 2)}
    for order, none in lowest.items():
        read = F.filter(F.col(f"_r.{order}"), lambda events: events.isNotNull())
        ends = F.flatten(F.transform(read, lambda events: F.transform(F.filter(events, lambda e: e["key"].isNotNull()), bound)))
        rows = rows.withColumn(f"_{order}", F.when(F.size(read) > 0, F.concat(F.array(none), F.array_sort(F.array_distinct(ends)))))
    number = lambda e, order: F.when(e["key"].isNotNull(), F.array_position(f"_{order}", bound(e)) - F.when(last(e), 1).otherwise(0))
    numbered = lambda r, order: F.transform(r[order], lambda e: F.struct(number(e, order).alias("key"), e["kind"].alias("kind"), e["version"].alias("version"))).alias(order)
    rows = rows.withColumn("_r", F.transform("_r", lambda r: F.struct(*[numbered(r, order) for order in lowest])))
    for order in lowest:
        rows = rows.withColumn("_n", F.explode(F.sequence(F.lit(0), F.coalesce(F.size(f"_{order}"), F.lit(0)))))
        rows = rows.withColumn(f"_{order}_from", F.get(f"_{order}", F.col("_n") - 1)).withColumn(f"_{order}_to", F.get(f"_{order}", F.col("_n")))
        rows = rows.withColumn(f"_{order}", F.nullif("_n", F.lit(0))).drop("_n")
    says = lambda r: F.coalesce(*[range_state(F.col(f"_{order}"), r[order]) for order in lowest])
    return _judged(rows, says).drop("_semver", "_own")


def same_name(ecosystem: Column, name: Column) -> Column:
    """The spelling under which an ecosystem knows a package: PyPI folds case and separators."""
    return F.when(ecosystem == "PyPI", python_name(name)).otherwise(name)


def _salts(packages: DataFrame, known: DataFrame) -> DataFrame:
    """(_key, _salts) of the names with a large share of all hits; there are fewer than four times the shuffle partitions."""
    width = shuffle_partitions(packages.sparkSession)
    hits = packages.groupBy("_key").agg(F.count("*").alias("_n")).join(known.groupBy("_key").agg(F.count("*").alias("_m")), "_key")
    hits = checkpointed(hits.select("_key", (F.col("_n").cast("double") * F.col("_m")).alias("_hits")))
    total = hits.agg(F.coalesce(F.sum("_hits"), F.lit(0.0)).alias("_all"))
    hot = hits.filter(F.col("_hits") > HOT_HITS).join(F.broadcast(total), F.col("_hits") * 4 * width > F.col("_all"))
    return hot.select("_key", F.ceil(F.col("_hits") * 4 * width / F.col("_all")).cast("int").alias("_salts"))


def advised(packages: DataFrame, batch: DataFrame, details: DataFrame) -> DataFrame:
    """Packages with each advisory that the batch answer names for them, and what its details say.

    ``packages`` (ecosystem, name, version, ...), ``batch`` (ecosystem, name, advisory),
    ``details`` (advisory, rating, ranges). An advisory without details is reported
    all the same: unknown ratings are low, and no fix is named.

    Versions and ranges are read before they meet, so a hit costs a few comparisons
    and is never moved. Names with many hits are spread over salts.
    """
    width = shuffle_partitions(packages.sparkSession)
    ecosystem = F.col("ecosystem")
    key = F.when(ecosystem.isin(*ORDERED), F.concat(ecosystem, F.lit(" "), same_name(ecosystem, F.col("name"))))
    rows = packages.withColumn("_key", key).filter("_key is not null")
    known = batch.select("ecosystem", key.alias("_key"), "advisory").filter("_key is not null").distinct()
    hot = F.broadcast(_salts(rows, known))
    salt = F.coalesce(F.pmod(F.xxhash64(*packages.columns), "_salts"), F.lit(0)).cast("int")
    rows = rows.join(hot, "_key", "left").withColumn("_salt", salt).drop("_salts").repartition(width, "_key", "_salt")
    rows = rows.withColumn("_semver", _point(semver_key(F.col("version")), 1)).withColumn("_own", _point(_own_key(ecosystem, F.col("version")), 1))
    listed = known.join(details, "advisory", "left").withColumn("severity", severity(F.col("rating"))).drop("rating")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    listed = listed.join(hot, "_key", "left").withColumn("_salt", copies).drop("_salts").repartition(width, "_key", "_salt")
    said = _stretches(listed).drop("ecosystem", "ranges").withColumnsRenamed({"_key": "_named", "_salt": "_copy"})
    on = (F.col("_key") == F.col("_named")) & (F.col("_salt") == F.col("_copy"))
    for order in ("_semver", "_own"):
        on &= (F.col(f"{order}_from").isNull() | (F.col(order) >= F.col(f"{order}_from"))) & (F.col(f"{order}_to").isNull() | (F.col(order) < F.col(f"{order}_to")))
    kept = [c for c in said.columns if not c.startswith("_") and c not in ("advisory", "severity", "fix_kind", "fix")]
    return rows.join(said, on).select("advisory", *packages.columns, *kept, "severity", "fix_kind", "fix")


def severity(rating: Column) -> Column:
    """Severity of an advisory's rating; unknown ones are low."""
    r = F.upper(rating)
    return F.when(r.isin("CRITICAL", "HIGH"), "high").when(r == "MODERATE", "medium").otherwise("low")


def package_set(packages: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Each package once, at its first line."""
    return packages.groupBy(*keys).agg(F.min(line).alias(line))


def list_hash(packages: DataFrame, by: str, item: Column) -> DataFrame:
    """One hash per list, whatever the order of its rows.

    Distinct items are hashed and their digits summed, so a list of a billion rows
    is a partial sum of fixed size and never gathered.
    """
    rows = packages.select(by, F.sha2(item, 256).alias("_h")).distinct()
    digits = lambda at: F.sum(F.conv(F.substring("_h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = rows.groupBy(by).agg(F.count("*").alias("items"), digits(1).alias("a"), digits(16).alias("b"), digits(31).alias("c"))
    return sums.select(by, F.sha2(F.concat_ws("|", F.col("items").cast("string"), "a", "b", "c"), 256).alias("hash"), "items")
