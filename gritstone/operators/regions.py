"""Points in regions, families of aliases, samples per stratum and dead lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import checkpointed

BLOCK = 64  # lines that share a join key, so a file with most of the points is many keys
MAX_ROUNDS = 100
SALTS = 32  # parts of a stratum that are ranked on their own before they meet


def enclosing(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(point, region): the narrowest region (rel, start, end, region) that holds a point (rel, line, point).

    Of equally narrow ones the later start wins, then the smaller name. A point in
    no region and rows with a null make no row. Regions are cut into blocks of
    lines: an equi-join on file and block with the bounds as a rest condition.
    """
    blocks = F.sequence(F.expr("start div 64"), F.expr("end div 64"))
    cut = regions.select("rel", "start", "end", "region").dropna().filter("start <= end").distinct().withColumn("block", F.explode(blocks))
    at = points.select("rel", "line", "point").dropna().withColumn("block", F.expr("line div 64"))
    held = at.join(cut, ["rel", "block"]).filter("line between start and end")
    order = F.struct(F.col("end") - F.col("start"), -F.col("start"), "region")
    return held.groupBy("point").agg(F.min_by("region", order).alias("region"))


def families(links: DataFrame, preferred: Column) -> DataFrame:
    """(name, family) of every name in ``links`` (a, b); the family is its first name, preferred ones before others.

    ``preferred`` is a condition on the column ``name``. Self links and rows with a
    null link nothing. A round takes the least label of all neighbours and then
    that label's own label; labels are checkpointed and the loop ends with the
    first round that changes none.
    """
    pairs = links.select("a", "b").dropna().filter("a <> b")
    both = checkpointed(pairs.union(pairs.select("b", "a")).distinct())
    key = F.concat(F.when(preferred, "0").otherwise("1"), F.col("name"))
    labels = checkpointed(both.select(F.col("a").alias("name")).distinct().select(key.alias("name"), key.alias("label")))
    edges = checkpointed(both.withColumn("name", F.col("a")).withColumn("ka", key).withColumn("name", F.col("b")).select("ka", key.alias("kb")))
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels.select(F.col("name").alias("kb"), "label"), "kb").groupBy(F.col("ka").alias("name")).agg(F.min("label").alias("near"))
        low = labels.join(near, "name").select("name", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = low.select(F.col("name").alias("label"), F.col("label").alias("far"))
        step = checkpointed(low.join(far, "label").select("name", "old", F.least("label", "far").alias("label")))
        labels = step.select("name", "label")
        if step.filter("label <> old").isEmpty():
            return labels.select(F.substring("name", 2, 2**31 - 1).alias("name"), F.substring("label", 2, 2**31 - 1).alias("family"))
    raise RuntimeError(f"families still change after {MAX_ROUNDS} rounds")


def sampled(rows: DataFrame, stratum: Column, key: Column, quota: int) -> DataFrame:
    """At most ``quota`` rows of each stratum, the least by hash of ``key``: the same rows on any cluster.

    Parts of a stratum are cut to the quota before they meet, so no task ranks a
    whole stratum. The quota is the operator's feature.
    """
    marked = rows.withColumn("_s", stratum).withColumn("_h", F.sha2(key, 256)).withColumn("_p", F.pmod(F.xxhash64("_h"), F.lit(SALTS)))
    part = Window.partitionBy("_s", "_p").orderBy("_h")
    whole = Window.partitionBy("_s").orderBy("_h")
    first = marked.withColumn("_k", F.row_number().over(part)).filter(F.col("_k") <= quota)
    return first.withColumn("_k", F.row_number().over(whole)).filter(F.col("_k") <= quota).drop("_s", "_h", "_p", "_k")


def after_end(lines: DataFrame, ends: str, exempt: str) -> DataFrame:
    """(rel, line) of lines (rel, line, text) that follow a line matching ``ends`` at the same indentation.

    Blank lines are passed over; a line matching ``exempt`` (a closing bracket, a
    label) is reachable. Only the first line of a dead stretch is given.
    """
    rows = lines.filter(F.col("text").rlike(r"\S"))
    before = F.lag("text").over(Window.partitionBy("rel").orderBy("line"))
    indent = lambda c: F.regexp_extract(c, r"^(\s*)", 1)
    rows = rows.withColumn("before", before).filter(F.col("before").rlike(ends) & ~F.col("text").rlike(exempt))
    return rows.filter(indent(F.col("before")) == indent(F.col("text"))).select("rel", "line")
