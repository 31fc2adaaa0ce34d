import base64
import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import scalar
from gritstone.operators import evaluation, imports, keyed, regions, testcases, verdict


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_enclosing_against_brute_force(spark):
    rnd = random.Random(3)
    held = [(f"f{rnd.randrange(3)}", s := rnd.randrange(1, 400), s + rnd.randrange(0, 200), f"r{k}") for k in range(60)]
    points = [(f"f{rnd.randrange(4)}", rnd.randrange(1, 620), f"p{k}") for k in range(200)]
    want = []
    for rel, line, point in points:
        fits = [(e - s, -s, name) for f, s, e, name in held if f == rel and s <= line <= e]
        if fits:
            want.append((point, min(fits)[2]))
    a = spark.createDataFrame([*points, (None, 3, "n"), ("f1", None, "m")], "rel string, line int, point string")
    b = spark.createDataFrame([*held, *held, ("f1", None, 9, "x"), ("f1", 9, 2, "turned")], "rel string, start int, end int, region string")
    assert values(regions.enclosing(a, b)) == sorted(want, key=repr)
    assert values(regions.enclosing(a.limit(0), b)) == []


def test_families_against_union_find(spark):
    rnd = random.Random(5)
    links = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(40)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(30)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[find(a)] = find(b)
    groups = {}
    for x in up:
        groups.setdefault(find(x), []).append(x)
    best = lambda g: min(g, key=lambda x: (not x.endswith("7"), x))
    want = sorted(((x, best(g)) for g in groups.values() if len(g) > 1 for x in g), key=repr)
    rows = spark.createDataFrame([*links, *links[:5], ("n1", None), (None, None)], "a string, b string")
    assert values(regions.families(rows, F.col("name").endswith("7"))) == want
    assert values(regions.families(rows.limit(0), F.lit(False))) == []


def test_sampled(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).alias("s"))
    got = values(regions.sampled(rows, F.col("s"), F.col("k"), 7))
    assert got == values(regions.sampled(rows.repartition(9), F.col("s"), F.col("k"), 7))
    assert sum(s for _, s in got) == 7 and len(got) == 14
    assert regions.sampled(rows.limit(4), F.lit(None).cast("string"), F.col("k"), 7).count() == 4


def test_after_end(spark):
    text = ["def f(x):", "    if x:", "        return 1", "    return 2", "", "    print(x)", "    print(1)", "def g():", "    raise ValueError(", "        1)", "    # end", "switch (a) {", "  case 1:", "    return b;", "    c();", "  default:", "    break;", "}"]
    rows = spark.createDataFrame([("a", k + 1, t) for k, t in enumerate(text)] + [("b", 1, "break"), ("c", 1, "x = 1")], "rel string, line int, text string")
    ends, exempt = r"^\s*(?:return\b.*|raise\b.*\)|break;?)\s*$", r"^\s*(?:[)}]|case\b|default\b)"
    assert values(regions.after_end(rows, ends, exempt)) == [("a", 15), ("a", 6)]


@pytest.mark.parametrize("aliases,want", [
    ([("@app/*", ["src/*"]), ("@app/ui/*", ["none/*", "ui/*"])], [(1, "src/a.ts"), (2, "ui/b.tsx"), (3, None)]),
    ([("@app/*", ["old/*", "src/*"])], [(1, "src/a.ts"), (2, None), (3, None)]),
    ([("kit", ["kit/src"])], [(4, "kit/src/index.ts")]),
    ([], []),
])
def test_resolved_by_alias(spark, aliases, want):
    edges = spark.createDataFrame([(1, "@app/a"), (2, "@app/ui/b"), (3, "@app/none"), (4, "kit"), (5, None), (6, "./a")], "edge_id long, specifier string")
    files = spark.createDataFrame([("src/a.ts",), ("ui/b.tsx",), ("src/a.js",), ("src/a.ts",), ("kit/src/index.ts",)], "rel string")
    got = values(imports.resolved_by_alias(edges, files.filter("rel <> 'src/a.js'"), aliases))
    assert got == want


def test_token_payload(spark):
    part = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    bodies = ['{"role":"anon"}', '{"role":"é?>~","exp":1}', "{}"]
    tokens = [f"{part('{}')}.{part(b)}.sig" for b in bodies]
    rows = spark.createDataFrame([*[(t,) for t in tokens], ("x",), ("a.*.b",), (None,)], "t string")
    assert [r[0] for r in rows.select(scalar.token_payload(F.col("t"))).collect()][:3] == bodies
    assert [r[0] for r in rows.select(scalar.token_payload(F.col("t"))).collect()][4:] == [None, None]


def test_planted_copies(spark):
    body = "function f(a) {\n  const total = a.size;\n  let s = 'x';\n" + "".join(f"  call{k}(total, s, other{k});\n" for k in range(40)) + "  return total + 3;\n}"
    rows = spark.createDataFrame([("f", body), ("f", body), ("g", "one line"), ("h", ""), ("n", None), (None, "x")], "id string, source string")
    copies = {(r.id, r.kind): r.planted for r in evaluation.planted(rows).collect()}
    assert set(copies) == {("f", k) for k in ("rename", "insert", "literals", "combined")}
    assert "const totalPlanted = " in copies["f", "rename"] and "total," not in copies["f", "rename"]
    assert copies["f", "insert"].split("\n")[1] == "  plantedCall(plantedValue, 1);"
    assert "'planted'" in copies["f", "literals"] and "+ 41;" in copies["f", "literals"]
    got = {r.kind: (r.n, r.recall) for r in evaluation.recall_by_kind(evaluation.planted(rows), 3, 0.7).collect()}
    assert got["insert"] == (1, 1.0) and got["literals"] == (1, 1.0) and got["rename"] == (1, 0.0)
    assert values(evaluation.recall_by_kind(evaluation.planted(rows.limit(0)), 3, 0.7)) == []


def test_cases_of_test_files(spark):
    source = """import x from './x';
describe('suite', () => {
  it('one', () => {
    expect(a).toBe(1);
    assert.equal(a, 1);
  });
  test.skip("two", () => {});
  xit(`three`, run);
  it(nameFor(x), () => {
    check();
  });
  it.only('five', () => { expect(1).toBe(1); });
});
"""
    rows = spark.createDataFrame([("a.test.ts", source), ("b.test.ts", ""), ("c.test.ts", None), ("d.ts", "iterate(1)\n")], "rel string, source string")
    found = testcases.cases(rows)
    got = [tuple(r) for r in found.orderBy("line").select("name", "line", "end_line", "skipped", "assertions").collect()]
    assert got == [("one", 3, 6, False, 2), ("two", 7, 7, True, 0), ("three", 8, 8, True, 0), ("<unnamed>", 9, 11, False, 0), ("five", 12, 13, False, 1)]
    assert [r.name for r in testcases.without_assertion(found).collect()] == ["<unnamed>"]
    assert sorted(r.name for r in testcases.skipped_names(found).collect()) == ["three", "two"]


def test_assembled_findings(spark):
    schema = "id string, rule string, rel string"
    stored = spark.createDataFrame([("1", "r", "a"), ("2", "r", "b"), (None, "r", "a"), ("1", "r", "a")], schema)
    fresh = spark.createDataFrame([("3", "r", "b"), ("4", "r", "a"), ("1", "s", "b")], schema)
    graph = spark.createDataFrame([("5", "g", "a"), ("3", "g", "b")], schema)
    got = verdict.assembled(stored, fresh, graph, spark.createDataFrame([("a",), ("a",)], "rel string"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "r", "a", "stored"), ("3", "r", "b", "fresh"), ("5", "g", "a", "graph")]


def test_answers_for_hot_keys(spark):
    rows = spark.range(9000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then null else concat('k', id % 50) end as key")
    answers = spark.createDataFrame([("hot", 1), ("k5", 2), ("unused", 3)], "key string, answer int")
    got = keyed.answered_by(rows, answers, "key")
    assert got.count() == 9000 and got.columns == ["key", "id", "answer"]
    want = {(r.id, {"hot": 1, "k5": 2}.get(r.key)) for r in rows.collect()}
    assert {(r.id, r.answer) for r in got.collect()} == want
    plain = keyed.answered_by(rows.filter("id < 90"), answers, "key")
    assert {(r.id, r.answer) for r in plain.collect()} == {x for x in want if x[0] < 90}
    assert keyed.answered_by(rows.limit(0), answers, "key").count() == 0
