import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gritstone.functions import scalar, secrets, versions
from gritstone.operators import advisories, evaluation, imports, orphans, sequences, verdict
from gritstone.plans import similarity, text
from gritstone.sources import lockfiles, manifests, repository
from gritstone.streaming import incremental


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_identifier_words(spark):
    got = {n: one(spark, scalar.identifier_words(F.lit(n))) for n in ("DAY_RECORD_id", "HTTPServer", "base64Encode", "parseV2Response", "to-kebab", "")}
    assert got == {
        "DAY_RECORD_id": ["day", "record", "id"],
        "HTTPServer": ["http", "server"],
        "base64Encode": ["base64", "encode"],
        "parseV2Response": ["parse", "v2", "response"],
        "to-kebab": ["to", "kebab"],
        "": [],
    }


@pytest.mark.parametrize("text,want", [("a\r\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("", [""]), ("x", ["x"])])
def test_lines(spark, text, want):
    assert one(spark, scalar.lines(F.lit(text))) == want


def test_entropy_mask_and_sets(spark):
    assert one(spark, scalar.shannon(F.lit("aabb"))) == 1.0
    assert one(spark, scalar.shannon(F.lit(""))) == 0.0
    assert one(spark, scalar.masked(F.lit("abcdefgh"))) == "abcd...(8 chars)"
    empty = F.array().cast("array<string>")
    assert one(spark, scalar.jaccard(empty, empty)) == 1.0
    assert one(spark, scalar.jaccard(empty, F.array(F.lit("a")))) == 0.0
    assert one(spark, F.size(scalar.shingles(F.array(*map(F.lit, "abcabcd")), 3))) == 4
    assert one(spark, scalar.shingles(empty, 3)) == []


def test_globs(spark):
    import re

    for glob, path, want in (("**/bin/**", "bin/x", True), ("**/bin/**", "a/bin/x", True), ("src/*.ts", "src/a/b.ts", True), ("*.{ts,js}", "a.js", True), ("a?.ts", "ab.ts", True), ("a[!b].ts", "ab.ts", False), ("src/**", "lib/a", False)):
        assert bool(re.match(scalar.glob_regex(glob), path)) is want, glob


def order(spark, key, names):
    rows = spark.createDataFrame([(n,) for n in names], "v string").withColumn("k", key(F.col("v")))
    return [r.v for r in rows.filter("k is not null").orderBy("k").collect()]


def test_version_orders(spark):
    assert order(spark, versions.semver_key, ["1.10.0", "1.2", "v1.2.1-rc.1", "1.2.1+b5", "x", "1.2.3.4"]) == ["1.2", "v1.2.1-rc.1", "1.2.1+b5", "1.10.0"]
    assert order(spark, versions.staged_key, ["1.0-p1", "1.0", "1.0.0-RC2", "1.0-beta", "dev-main", "0.9"]) == ["0.9", "1.0-beta", "1.0.0-RC2", "1.0", "1.0-p1"]
    names = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+local", "1.0.post1", "1!0.5", "what"]
    assert order(spark, versions.pep440_key, names[::-1]) == names[:-1]


def test_ranges(spark):
    adv = [
        ("n", "A", [("fixed", "2.0"), ("introduced", "1.0")]),
        ("n", "B", [("introduced", "0"), ("last_affected", "1.5")]),
        ("n", "C", [("introduced", "bad")]),
        ("n", "D", [("introduced", "3")]),
        ("n", "E", []),
    ]
    listed = spark.createDataFrame(adv, "name string, advisory string, events array<struct<kind:string,version:string>>")
    packs = spark.createDataFrame([(v, "n", v) for v in ("0.5", "1.5", "2.0", "3.1", "junk")], "package string, name string, version string")
    got = values(advisories.affected(packs, listed, versions.semver_key, ["name"]).select("package", "advisory", "fix"))
    assert got == [("0.5", "B", None), ("1.5", "A", "2.0"), ("1.5", "B", None), ("3.1", "D", None)]


def test_ranges_of_ecosystems(spark):
    ranges = [("GIT", [("introduced", "0")]), ("ECOSYSTEM", [("introduced", "1.0"), ("fixed", "2.0")]), ("SEMVER", [("introduced", "3")])]
    rows = [("1.5", ranges), ("1.0rc1", ranges), ("3.1", ranges), ("2.5", ranges[1:]), ("x", ranges), ("1.5", []), ("1.5", None)]
    frame = spark.createDataFrame(rows, "version string, ranges array<struct<type:string,events:array<struct<kind:string,version:string>>>>")
    got = {e: [(r.fix_kind, r.fix) for r in advisories.with_fix(frame, e).collect()] for e in ("PyPI", "npm")}
    assert got["PyPI"] == [("named", "2.0"), ("unreadable", None), ("none", None), ("outside", None), ("unreadable", None), ("outside", None), ("none", None)]
    assert got["npm"] == [("unreadable", None), ("unreadable", None), ("none", None), ("unreadable", None), ("unreadable", None), ("outside", None), ("none", None)]
    packs = spark.createDataFrame([("PyPI", "zope.Interface", "1.5"), ("npm", "left-pad", "1")], "ecosystem string, name string, version string")
    batch = spark.createDataFrame([("PyPI", "Zope_interface", "A"), ("PyPI", "zope-interface", "A"), ("npm", "left_pad", "B"), ("npm", "left-pad", "C")], "ecosystem string, name string, advisory string")
    details = spark.createDataFrame([("A", "High", ranges)], "advisory string, rating string, ranges array<struct<type:string,events:array<struct<kind:string,version:string>>>>")
    hits = advisories.advised(packs, batch, details).select("advisory", "severity", "fix_kind", "fix")
    assert values(hits) == [("A", "high", "named", "2.0"), ("C", "low", "none", None)]


def test_numbers_too_long_for_a_key_make_no_version(spark):
    for key in (versions.staged_key, versions.pep440_key):
        assert order(spark, key, ["1." + "9" * 20, "2", "0" * 20 + "1.5", "1"]) == ["1", "0" * 20 + "1.5", "2"]
    packs = spark.createDataFrame([("PyPI", "p", "1"), ("PyPI", "q", "9" * 20)], "ecosystem string, name string, version string")
    batch = spark.createDataFrame([("PyPI", "p", "A"), ("PyPI", "q", "A")], "ecosystem string, name string, advisory string")
    ranges = [("ECOSYSTEM", [("introduced", "0"), ("fixed", "2")])]
    details = spark.createDataFrame([("A", "LOW", ranges)], "advisory string, rating string, ranges array<struct<type:string,events:array<struct<kind:string,version:string>>>>")
    assert values(advisories.advised(packs, batch, details).select("name", "fix_kind", "fix")) == [("p", "named", "2"), ("q", "unreadable", None)]


def test_hits_are_judged_by_stretches_of_versions(spark, monkeypatch):
    """Each hit says what its ranges say of its version, whatever they hold, salted or not; ranges and versions are read before they meet."""
    draw = random.Random(5)
    said = ["0", "1", "1.0", "1.0.0", "1.0rc1", "1.0-rc.1", "1.0-beta2", "1.5", "v2", "2.0.post1", "2.0-p1", "3", "1!0", "junk", "", None]
    event = lambda: None if draw.random() < 0.02 else (draw.choice(["introduced", "fixed", "last_affected", "introduced", "fixed", "limit", None]), draw.choice(said[:-3] if draw.random() < 0.95 else said))
    span = lambda: None if draw.random() < 0.02 else (draw.choice(["SEMVER", "ECOSYSTEM", "GIT", "ECOSYSTEM", None]), None if draw.random() < 0.03 else [event() for _ in range(draw.randrange(5))])
    details = [(f"A{i}", draw.choice(["High", "moderate", None]), None if i % 29 == 0 else [span() for _ in range(draw.randrange(4))]) for i in range(240)]
    named = [(e, "p", f"A{i}") for i in range(250) for e in (("PyPI", "npm", "Packagist", "Go")[i % 4], "PyPI")]
    packs = spark.createDataFrame([(k, e, "p", v) for k, (e, v) in enumerate((e, v) for e in ("PyPI", "npm", "Packagist", "Go", None) for v in said)], "id int, ecosystem string, name string, version string")
    batch = spark.createDataFrame(named, "ecosystem string, name string, advisory string")
    details = spark.createDataFrame(details, "advisory string, rating string, ranges array<struct<type:string,events:array<struct<kind:string,version:string>>>>")
    plain = packs.join(batch.distinct(), ["ecosystem", "name"]).join(details, "advisory", "left")
    want = Counter((r.id, r.advisory, r.fix_kind, r.fix) for e in ("PyPI", "npm", "Packagist") for r in advisories.with_fix(plain.filter(F.col("ecosystem") == e), e).collect())
    assert {kind for _, _, kind, _ in want} == {"named", "none", "unreadable", "outside"} and len(want) > 4000
    for hot in (10**9, 10):
        monkeypatch.setattr(advisories, "HOT_HITS", hot, raising=False)
        hits = advisories.advised(packs, batch, details)
        assert Counter((r.id, r.advisory, r.fix_kind, r.fix) for r in hits.collect()) == want
    # Above the join that makes the hits nothing is read, matched or joined again.
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join ")]
    assert plan.count("Join Inner", 0, len(top) + 12) == 1 and not any(word in top for word in ("Union", "transform(", "RLIKE", "regexp"))


def test_values_that_may_be_credentials(spark):
    want = {"Zk3vX9qLm2Rt8WcYb5Nd7Hs1": True, "Zk3vX9qLm2Rt8W": False, "abcABC123abcABC123abcABC123": False, "src/components/App_v2.tsx": False, "Zk3vX9q123456t8WcYb5Nd7": False, "https://a.B1/zk3vX9qLm2Rt8": False, "myTestKey3vX9qLm2Rt8WcY": False, "zk3vx9qlm2rt8wcyb5nd7hs1": False, "": False}
    rows = spark.createDataFrame([(v,) for v in [*want, None]], "v string").select("v", secrets.looks_generated(F.col("v")).alias("x"))
    assert {r.v: r.x for r in rows.collect()} == {**want, None: False}
    assert one(spark, secrets.is_filler(F.lit("xxxxxxxxxxxx"))) and not one(spark, secrets.is_filler(F.lit("abcdefgh")))
    pairs = {"dXNlcjpwYXNz": True, "OnBhc3M=": False, "dXNlcjo=": False, "bm9wZQ==": False, "/////w==": False, "a": False}
    assert {v: one(spark, secrets.decodes_to_a_pair(F.lit(v))) for v in pairs} == pairs


FINDING = "id string, rule string, severity string, confidence string, file string, span struct<start_line:int,start_col:int,end_line:int,end_col:int>, evidence string"


def findings(spark, rows):
    return spark.createDataFrame([(i, r, s, c, f, (n, 0, n, 0), e) for i, r, s, c, f, n, e in rows], FINDING)


def test_verdict(spark):
    rows = findings(spark, [("1", "r", "low", "high", "b", 1, "x|y"), ("1", "r", "low", "high", "b", 1, "x|y"), ("2", "r", "high", "medium", "a", 2, None), (None, "r", "high", "high", "a", 2, None)])
    one_each = verdict.one_per_id(rows)
    assert values(verdict.counts(one_each)) == [(1, 0, 1, 1, "block")]
    assert values(verdict.counts(one_each.filter("id = '2'"))) == [(1, 0, 0, 0, "advisory")]
    assert values(verdict.counts(one_each.limit(0))) == [(0, 0, 0, 0, "pass")]
    # Confidence outranks severity, and a cap drops the rest.
    assert [(r.id, r.truncated) for r in verdict.top(one_each, 1).collect()] == [("1", 1)]
    assert values(verdict.without_baseline(one_each, one_each.filter("id = '1'")).select("id")) == [("2",)]
    allowed = spark.createDataFrame([("b", 1)], "rel string, line int")
    assert values(verdict.without_allowed(one_each, allowed).select("id")) == [("2",)]
    assert values(verdict.overridden(one_each, {"r": "medium"}).select("severity")) == [("medium",), ("medium",)]
    assert values(verdict.overridden(one_each, {"r": "medium"}, {"r": "high"}).select("severity")) == [("high",), ("high",)]
    assert {r.id: r.row for r in verdict.markdown_rows(one_each).collect()}["1"] == r"| low | r | b:1 | x\|y |"
    assert json.loads({r.id: r.result for r in verdict.sarif_results(one_each).collect()}["2"])["level"] == "error"


def test_ids_survive_moved_lines(spark):
    def ids(lines):
        rows = spark.createDataFrame([("f", k + 1, t) for k, t in enumerate(lines)], "rel string, line int, text string")
        out = verdict.identified(verdict.with_ordinals(rows, "rel"), "r").filter("text like '%dbg%'")
        return [r.id for r in out.orderBy("line").collect()]

    a, b = ids(["x", " dbg", "dbg"]), ids(["y", "z", "dbg ", "q", "dbg"])
    assert a == b and len(set(a)) == 2


EDGE = "edge_id long, from_rel string, to_rel string, specifier string, name string, kind string, resolution string, line int, seen_at timestamp, loaded_at timestamp"
T0 = dt.datetime(2025, 1, 10)


def edges(spark, rows):
    return spark.createDataFrame([(k, a, b, s, n, "import", "resolved", k, T0, T0) for k, (a, b, s, n) in enumerate(rows)], EDGE)


def test_graph(spark):
    e = imports.one_per_edge(edges(spark, [("a.ts", ".\\b.ts", "./b", "x"), ("./c.ts", "b.ts", "./b", ""), ("b.ts", "d/index.ts", "./d", "*"), ("d/index.ts", None, "react", "r")]))
    files = spark.createDataFrame([(x,) for x in ("a.ts", "b.ts", "c.ts", "d/index.ts", "app/p.ts")], "rel string")
    assert values(imports.dead_files(files, e, ["app/**"])) == [("a.ts",), ("c.ts",)]
    exports = spark.createDataFrame([("b.ts", "x"), ("b.ts", "y"), ("a.ts", "main"), ("d/index.ts", "q")], "rel string, name string")
    assert values(imports.dead_exports(exports, e)) == [("b.ts", "y")]
    assert values(imports.neighbours(e, spark.createDataFrame([("b.ts",)], "rel string"))) == [("a.ts",), ("b.ts",), ("c.ts",), ("d/index.ts",)]
    assert values(imports.boundary_violations(e, [("no-d", "*", ["d/**"], []), ("only-b", "a.ts", [], ["b.*"]), ("only-c", "c.ts", [], ["c/**"])]).select("from_rel", "label")) == [("b.ts", "no-d"), ("c.ts", "only-c")]
    left = imports.without_departed(e, files.filter("rel <> 'b.ts'"))
    assert values(left.select("from_rel", "to_rel", "resolution")) == [("a.ts", None, "unresolved"), ("c.ts", None, "unresolved"), ("d/index.ts", None, "resolved")]
    got = dict(values(imports.resolved(e, files)))
    assert got == {0: "b.ts", 1: "b.ts", 2: "d/index.ts"}


def test_resolution_order(spark):
    names = ["a.js", "a.ts", "b.ts", "b.js.ts", "t.d.ts", "d/index.js", "d/index.tsx", "d.mts", "e.tsx", "f.cts", "lib/x.ts", "top.ts"]
    files = spark.createDataFrame([(x,) for x in names], "rel string")
    want = {"./a": "a.ts", "./a.js": "a.js", "./b.js": "b.ts", "./t": None, "./t.d.ts": None, "./d": "d.mts", "./d/": "d.mts", "./e.jsx": "e.tsx", "./e.js": "e.tsx", "./f.cjs": "f.cts", "../x": None, "./lib/../top": "top.ts", "./lib/x.js": "lib/x.ts", "react": None}
    e = edges(spark, [("m.ts", None, s, "x") for s in want] + [(None, None, "./a", "x"), ("lib/y.ts", None, "../../top", "x"), ("lib/y.ts", None, "..", "x")])
    got = {r.edge_id: r.target for r in imports.resolved(e, files).collect()}
    assert got == {k: t for k, (s, t) in enumerate(want.items()) if s.startswith(".")} | {len(want) + 1: None, len(want) + 2: None}
    aliased = edges(spark, [("m.ts", None, s, "x") for s in ("@a/x", "@a/none", "@/top", "./a", "zz")])
    found = imports.resolved_by_alias(aliased, files, [("@a/*", ["none/*", "lib/*"]), ("@*", ["../up*", ".*"])])
    assert {r.edge_id: r.target for r in found.collect()} == {0: "lib/x.ts", 1: None, 2: "top.ts"}
    packages = spark.createDataFrame([("@s/p", "lib", "x.js"), ("d", ".", None), (None, "lib", None)], "name string, dir string, main string")
    inside = edges(spark, [("m.ts", None, s, "x") for s in ("@s/p", "@s/p/x", "d/a", "d", "other", "@s")])
    assert {r.edge_id: r.target for r in imports.resolved_by_package(inside, files, packages).collect()} == {0: "lib/x.ts", 1: "lib/x.ts", 2: "a.ts", 3: None}


def test_made_imports(spark, tmp_path):
    source = """import def, { a as b, type C,
  d } from './m';
import * as all from "../n";
import './effects';
export { e as f } from './o';
export * from './p';
const q = require('./q'), r = require('./r');
const s = await import('./s');
export const one = 1;
export default function two() { return one + b; }
export { q as three,
  s };
"""
    rows = [("x.ts", source, None)] * 2 + [("y.ts", "import { z } from './z';", True), ("z.py", "import os\n", False), (None, source, False), ("n.ts", None, False), ("e.ts", "", False)]
    spark.createDataFrame(rows, "rel string, source string, has_error boolean").write.parquet(str(tmp_path / "parsed_files.parquet"))
    got = values(text.made_imports(spark, str(tmp_path)).select("specifier", "name", "kind"))
    assert got == sorted(
        [("./m", "default", "import"), ("./m", "a", "import"), ("./m", "C", "import"), ("./m", "d", "import"), ("../n", "*", "import"), ("./effects", "", "import"), ("./o", "e", "reexport"), ("./p", "*", "reexport"), ("./q", "*", "require"), ("./r", "*", "require"), ("./s", "*", "dynamic")],
        key=repr,
    )
    assert values(text.exported_names(spark, str(tmp_path))) == [("x.ts", n) for n in ("default", "f", "one", "s", "three")]
    assert values(text.unused_imports(spark, str(tmp_path))) == [("x.ts", "C"), ("x.ts", "d")]


def test_places_within_hot_groups(spark):
    rows = findings(spark, [(f"{k:04d}", f"r{k % 7}", "low", "high", "a/x" if k % 3 else "b/y", k % 11, "e") for k in range(500)] + [("n1", None, None, None, None, 1, None), ("n2", "r", None, None, None, 1, None)])
    rows = rows.withColumn("repo", F.substring_index("file", "/", 1))
    got = {r.id: r.place for r in verdict.ranked(rows, "repo").collect()}
    w = Window.partitionBy("repo").orderBy(*verdict.total_order())
    assert got == {r.id: r.place for r in rows.withColumn("place", F.row_number().over(w)).collect()}


def test_orphans_small(spark):
    sec = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    files = spark.createDataFrame([("a/x.ts", sec - 5), ("a/x.ts", sec - 5), ("a/b/index.tsx", sec - 5), ("late.ts", sec + 5), ("back.ts", sec - 9), ("back.ts", sec - 1), (None, sec), ("n.ts", None)], "rel string, indexed_at long")
    removed = spark.createDataFrame([("a/x.ts", sec - 9), ("back.ts", sec - 5), ("gone.ts", sec - 5), ("back.ts", None)], "rel string, removed_at long")
    rows = [
        ("a\\x.ts", None, "./b", "x"),  # an index file answers
        ("./a/x.ts", None, "../late.js", "x"),  # indexed only later
        ("a/x.ts", "back.ts", "y", "x"),  # came back
        ("nowhere.ts", None, "react", "x"),  # refers to nothing, from is missing
        ("a/x.ts", None, "../../up", "x"),  # above the root
        (None, None, "./b", "x"),
        ("a/x.ts", "A/X.ts", "./b", "x"),  # case counts
    ]
    e = edges(spark, rows)
    e = e.union(e)
    assert values(orphans.dangling_imports(e, files, removed)) == [(1, "to"), (3, "from"), (4, "to"), (6, "to")]
    rates = values(orphans.dangling_rates(e, files, removed))
    assert rates == [("edges.from_rel", "2025-01", 6, 1), ("edges.to_rel", "2025-01", 5, 3)]
    for empty in (e.limit(0), e):
        assert values(orphans.dangling_imports(empty, files.limit(0), removed.limit(0)).filter("side = 'none'")) == []
    assert values(orphans.dangling_imports(e.limit(0), files, removed)) == []


def test_orphans_hot_key(spark):
    e = spark.range(5000).selectExpr("id as edge_id", "'a.ts' as from_rel", "if(id % 3 = 0, 'hot.ts', concat('f', id, '.ts')) as to_rel", "'s' as specifier", "timestamp_seconds(1000 + id) as seen_at")
    files = spark.createDataFrame([("a.ts", 0), ("hot.ts", 3000)], "rel string, indexed_at long")
    removed = spark.createDataFrame([("hot.ts", 4000)], "rel string, removed_at long")
    got = orphans.dangling_imports(e, files, removed)
    want = e.filter("to_rel <> 'hot.ts' or not (edge_id >= 2000 and edge_id < 3000)").count()
    assert got.count() == want and got.filter("side = 'from'").count() == 0


def test_bitmaps():
    import numpy as np

    for n in (0, 3, 2000):
        bits = np.zeros(orphans.RANGE_BITS, bool)
        bits[np.random.default_rng(n).choice(orphans.RANGE_BITS, n, replace=False)] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        assert (orphans.expand(orphans.compress(packed)) == bits).all()
    assert not orphans.expand(None).any()


EVENTS = [(1, 1, "error"), (1, 2, "error"), (1, 3, "error"), (1, 4, "error"), (1, 5, "purchase"), (1, 6, "error"), (2, 7, "click")]


def events(spark):
    return spark.createDataFrame([(u, e, k, T0 + dt.timedelta(minutes=e)) for u, e, k in EVENTS], "user_id long, event_id long, event_type string, ts timestamp")


def test_sequences(spark):
    ev = events(spark)
    rounds = sequences.counted_with_reset(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", 3)
    want = [(1, 1, False), (2, 2, False), (3, 3, False), (4, 3, True), (5, 0, True), (6, 1, True), (7, 0, False)]
    assert values(rounds.select("event_id", "round", "silent")) == want
    assert values(sequences.runs(ev, "user_id", ["event_id"], "event_type", 3)) == [(1, "error", 1, 4)]
    assert values(sequences.latest(ev, ["user_id"], ["ts"]).select("event_id")) == [(6,), (7,)]
    assert values(sequences.newly(ev.filter("event_id > 4"), ev.filter("event_id < 5"), "user_id", "event_type")) == [(1, "purchase", True), (2, "click", False)]
    assert values(sequences.uncovered(ev.filter("event_type = 'error'"), ev.filter("event_type = 'purchase'"), "user_id", "event_id").select("event_id")) == [(1,), (2,), (3,), (4,)]
    now = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2")], "rel string, h string")
    before = spark.createDataFrame([("a", "1"), ("b", "0"), ("d", "3")], "rel string, h string")
    assert values(sequences.changed(now, before, "rel", "h")) == [("b", "changed"), ("c", "added"), ("d", "gone")]
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "rel string, content_hash string")
    cache = spark.createDataFrame([("a", "1", "r", "k"), ("a", "1", "s", "k"), ("b", "old", "r", "k"), ("b", "2", "s", "k")], "rel string, content_hash string, rule string, config_hash string")
    assert values(sequences.served(files, cache, ["r", "s"], "k")) == [("a",)]
    stat = spark.createDataFrame([("a", 1, 1), ("b", 0, 1), ("c", 2, None)], "rel string, size long, mtime long")
    assert values(sequences.surely_unchanged(stat, stat)) == [("a",)]
    kept = "rel string, content_hash string, size int, mtime int"
    seen = spark.createDataFrame([("a", "1", 5, 5), ("b", "1", 5, 5), ("c", "1", 0, 5), ("d", None, 5, 5), ("e", "1", 5, 6)], kept)
    stored = spark.createDataFrame([("a", "1", 5, 5), ("b", "2", 4, 4), ("c", "1", 4, 4), ("d", None, 4, 4), ("e", "1", None, 6)], kept)
    assert values(sequences.refreshed(seen, stored)) == [("e", 5, 6)]


def test_nested_pairs(spark):
    rows = [("outer", "f", 1, 9, "f", 3, 4), ("inner", "f", 3, 4, "f", 1, 9), ("after", "f", 1, 2, "f", 3, 4), ("other", "f", 1, 9, "g", 3, 4), ("unknown", "f", None, 9, "f", 3, None)]
    pairs = spark.createDataFrame(rows, "n string, a_file string, a_start_line int, a_end_line int, b_file string, b_start_line int, b_end_line int")
    assert values(evaluation.not_nested(pairs).select("n")) == [("after",), ("other",), ("unknown",)]


def test_evaluation(spark):
    rows = [("a", "b", True, 0.2, None), ("b", "c", False, 0.8, True), ("c", "d", None, 0.5, False), ("d", "e", False, None, True)]
    pairs = spark.createDataFrame(rows, "a_id string, b_id string, structural_match boolean, jaccard double, sig_gate boolean")
    swept = evaluation.sweep(pairs, F.coalesce("sig_gate", F.lit(False)), [0.3, 0.6, 0.9])
    assert values(swept) == [(0.3, 3, 1, 2, 0.333333, 0.5), (0.6, 2, 1, 2, 0.5, 0.5), (0.9, 1, 0, 2, 0.0, 0.0)]
    assert values(evaluation.chosen(swept, 0.5)) == [(0.6, 0.5)]
    assert values(evaluation.chosen(swept, 0.9)) == [(None, None)]
    assert [r[0] for r in pairs.select(evaluation.bucket()).collect()] == ["structural", "high", "low", "below"]


def test_lock_files(spark):
    texts = {
        "package-lock.json": json.dumps({"packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.0"}, "x/node_modules/@s/b": {"version": "2"}, "node_modules/l": {"link": True, "version": "3"}}}),
        "yarn.lock": '# c\n"@s/p@^1", "@s/p@^2":\n  version "2.1"\n  dependencies:\n    version "9"\nq@1:\n  version: 3\n',
        "pnpm-lock.yaml": "packages:\n  /@s/k@1.2(react@18):\n    dev: true\n  m@3.4.5:\n",
        "composer.lock": json.dumps({"packages": [{"name": "v/a", "version": "v1.2"}, {"name": "v/b", "version": "dev-main"}], "packages-dev": [{"name": "v/c", "version": "2"}]}),
        "poetry.lock": '[[package]]\nname = "My_Pack"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\n',
        "sub/requirements.txt": "A_b[x]==1.0 ; python_version>'3'\nc>=2\nd==3 # why\n-r other\nd==3\n",
    }
    files = spark.createDataFrame(list(texts.items()), "rel string, text string")
    got = {(r.lock_rel, r.name, r.version) for r in lockfiles.packages(files).collect()}
    assert got == {
        ("package-lock.json", "a", "1.0"), ("package-lock.json", "@s/b", "2"), ("yarn.lock", "@s/p", "2.1"), ("yarn.lock", "q", "3"),
        ("pnpm-lock.yaml", "@s/k", "1.2"), ("pnpm-lock.yaml", "m", "3.4.5"), ("composer.lock", "v/a", "1.2"), ("composer.lock", "v/c", "2"),
        ("poetry.lock", "my-pack", "1"), ("poetry.lock", "b", "2"), ("sub/requirements.txt", "a-b", "1.0"), ("sub/requirements.txt", "d", "3"),
    }


def test_manifests(spark):
    texts = {
        "package.json": json.dumps({"name": "root", "main": "lib/main", "module": "./m.mjs", "bin": "cli.js", "workspaces": ["packages/*", "./tools/one/"], "scripts": {"a": "tsx ./run/a.ts --x=b.json && node 'run/c.mjs'", "b": "echo"}}),
        "packages/p/package.json": json.dumps({"name": "@s/p", "bin": {"x": "./bin/x.ts", "y": "../../../up.js"}, "workspaces": {"packages": ["q"]}}),
        "packages/p/q/package.json": json.dumps({"name": "q", "main": "q.js"}),
        "tools/one/package.json": json.dumps({"name": "one"}),
        "other/package.json": "no json",
        "x/notpackage.json": "{}",
        "n/package.json": None,
    }
    found = manifests.manifests(spark.createDataFrame(list(texts.items()), "rel string, text string"))
    got = {r.rel: (r.name, sorted(r.entries), r.workspaces) for r in found.collect()}
    assert got["package.json"] == ("root", ["cli.js", "lib/main", "m.mjs", "run/a.ts", "run/c.mjs"], ["packages/*", "./tools/one/"])
    assert got["packages/p/package.json"] == ("@s/p", ["packages/p/bin/x.ts"], ["q"])
    assert got["other/package.json"] == (None, [], []) and set(got) == set(texts) - {"x/notpackage.json", "n/package.json"}
    assert values(manifests.workspace_packages(found)) == [("@s/p", "packages/p", None), ("one", "tools/one", None), ("q", "packages/p/q", "q.js")]
    files = spark.createDataFrame([(x,) for x in ("lib/main.ts", "cli.js", "run/a.ts", "packages/p/bin/x.ts", "loose.ts")], "rel string")
    entries = manifests.entry_files(found, files)
    assert values(entries) == [("cli.js",), ("lib/main.ts",), ("packages/p/bin/x.ts",), ("run/a.ts",)]
    assert values(imports.dead_files(files, edges(spark, []), [], entries)) == [("loose.ts",)]


def test_repository_and_baseline(spark, tmp_path):
    for name, data in {"a.ts": b"x\n", "node_modules/b.ts": b"y", "c.bin": b"\xff\xfe\x00"}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data)
    assert values(repository.text_files(spark, str(tmp_path / "r")).select("rel", "text", "size")) == [("a.ts", "x\n", 2)]
    (tmp_path / "b.json").write_text(json.dumps({"version": "1", "entries": [{"id": "1", "rule": "r"}]}))
    assert values(repository.baseline(spark, str(tmp_path / "b.json")).select("id", "rule")) == [("1", "r")]


def test_streams_agree_with_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).repartition(1).write.parquet(src)
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = incremental.counted_rounds(stream).writeStream.format("memory").queryName("rounds").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = sequences.counted_with_reset(events(spark), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", 3)
    assert values(spark.table("rounds").select("event_id", "round", "silent")) == values(batch.select("event_id", F.col("round").cast("long"), "silent"))
    w = incremental.indexed(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("event_id"))
    w.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EVENTS)


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)
    assert "p4_found" in q and e.entry(spark).count() == 1


def test_signature_scores_of_pairs_stored_turned_round(spark, tmp_path):
    functions = [(i, ["f"], 1, True, False) for i in "abc"]
    spark.createDataFrame(functions, "id string, callees array<string>, param_count int, returns_value boolean, is_async boolean").write.parquet(str(tmp_path / "function_records.parquet"))
    stored = [("b", "a"), ("a", "c"), ("c", "a"), ("c", "c"), ("c", None), ("z", "b")]
    spark.createDataFrame(stored, "a_id string, b_id string").write.parquet(str(tmp_path / "candidate_pairs.parquet"))
    got = sorted(tuple(r) for r in similarity.signature_scores(spark, str(tmp_path)).collect())
    assert got == [("a", "b", 1.0), ("a", "c", 1.0)]
