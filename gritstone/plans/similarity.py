"""Queries over function records and stored candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import evaluation as E
from gritstone.session import table

MIN_TOKENS = 40
RECALL = 0.9
PLANTED = 0.7


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair of different ids, as good as its best row."""
    rows = table(spark, sf_dir, "candidate_pairs").filter("a_id is not null and b_id is not null and a_id <> b_id")
    return rows.groupBy(E.pair_key().alias("pair")).agg(
        F.max("structural_match").alias("structural_match"), F.max("jaccard").alias("jaccard"), F.max("sig_sim").alias("sig_sim"), F.max("sig_gate").alias("sig_gate")
    )


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "function_records").filter("id is not null").dropDuplicates(["id"])


def structural_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structural_classes(table(spark, sf_dir, "function_records"), MIN_TOKENS)


def structure_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural hash of each function, made again from its tokens."""
    rows = _functions(spark, sf_dir).filter("toks is not null")
    return rows.select("id", F.sha2(F.array_join("toks", "\x1f"), 256).alias("hash"), F.size("toks").cast("long").alias("tokens"))


def pair_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy(E.bucket().alias("bucket")).agg(F.count("*").alias("pairs"))


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).filter(E.is_duplicate(0.7, gated=True)).select("pair", "jaccard")


def signature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature similarity of stored pairs whose functions still exist, made again; a_id < b_id, however stored."""
    pairs = table(spark, sf_dir, "candidate_pairs").filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    f = _functions(spark, sf_dir).select("id", "callees", "param_count", "returns_value", "is_async")
    rows = pairs.join(f.alias("a"), F.col("a_id") == F.col("a.id")).join(f.alias("b"), F.col("b_id") == F.col("b.id"))
    return rows.select("a_id", "b_id", F.round(E.signature_similarity("a", "b"), 6).alias("score"))


def precision_recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("structural_match", F.lit(False))
    return E.sweep(pairs, F.coalesce(F.col("sig_gate"), F.lit(False)))


def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chosen(precision_recall_sweep(spark, sf_dir), RECALL)


def weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of gated pairs per bucket, weighted by all pairs of the bucket."""
    rows = _pairs(spark, sf_dir).withColumn("stratum", E.bucket())
    labelled = rows.filter("sig_gate is not null").withColumn("hit", F.col("sig_gate"))
    return E.weighted_precision(labelled, rows)


def gate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = F.when(F.col("sig_gate"), "yes").when(~F.col("sig_gate"), "no").otherwise("unknown")
    rows = _pairs(spark, sf_dir).select(E.bucket().alias("bucket"), gate.alias("gate")).groupBy("bucket").pivot("gate", ["yes", "no", "unknown"]).agg(F.count(F.lit(1)))
    return rows.select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("yes", "no", "unknown")])


def pair_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each function; a hub is one partially aggregated key."""
    rows = table(spark, sf_dir, "candidate_pairs").filter("structural_match and a_id <> b_id").select("a_id", "b_id")
    both = rows.union(rows.select("b_id", "a_id")).distinct()
    return both.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("links"))


def planted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edited copies of each kind a similarity of 0.7 on three words in a row would find."""
    return E.recall_by_kind(E.planted(table(spark, sf_dir, "function_records")), 3, PLANTED)


def pairs_not_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pairs of functions that still exist, neither of which begins inside the other."""
    rows = table(spark, sf_dir, "candidate_pairs").filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    f = _functions(spark, sf_dir).select("id", "file", "start_line", "end_line")
    sides = {x: f.select(*[F.col(c).alias(f"{x}_{c}") for c in ("id", "file", "start_line", "end_line")]) for x in "ab"}
    return E.not_nested(rows.join(sides["a"], "a_id").join(sides["b"], "b_id")).select("a_id", "b_id")


def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pairs of the report: equal structure, then likeness, then ids."""
    rows = _pairs(spark, sf_dir).withColumn("structural_match", F.coalesce("structural_match", F.lit(False)))
    return rows.orderBy(F.desc("structural_match"), F.desc_nulls_last("jaccard"), "pair").limit(100).select("pair", "structural_match", "jaccard")


QUERIES = {f.__name__: f for f in (structural_dupes, structure_hash, pair_buckets, duplicate_pairs, signature_scores, precision_recall_sweep, chosen_threshold, weighted_precision, gate_breakdown, pair_degrees, pairs_not_nested, first_pairs, planted_recall)}

_P = "p AS (SELECT concat_ws('|', least(a_id, b_id), greatest(a_id, b_id)) AS pair, bool_or(structural_match) AS structural_match, max(jaccard) AS jaccard, max(sig_sim) AS sig_sim, bool_or(sig_gate) AS sig_gate FROM candidate_pairs WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND a_id <> b_id GROUP BY 1)"
_B = "CASE WHEN coalesce(structural_match, false) THEN 'structural' WHEN jaccard >= 0.6 THEN 'high' WHEN jaccard >= 0.3 THEN 'low' ELSE 'below' END"
_FN = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file) AS k FROM function_records WHERE id IS NOT NULL) WHERE k = 1)"
_T = "t AS (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS threshold)"
_SWEEP = f"{_P}, {_T}, s AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE jaccard >= CAST(threshold AS DOUBLE)) AS predicted, count(*) FILTER (WHERE jaccard >= CAST(threshold AS DOUBLE) AND sig_gate) AS hits, count(*) FILTER (WHERE sig_gate) AS actual FROM p, t GROUP BY 1), w AS (SELECT *, round(CASE WHEN predicted > 0 THEN CAST(hits AS DOUBLE) / predicted ELSE 0.0 END, 6) AS precision, round(CASE WHEN actual > 0 THEN CAST(hits AS DOUBLE) / actual ELSE 0.0 END, 6) AS recall FROM s)"

ORACLE_SQL = {
    "structural_dupes": "WITH l AS (SELECT DISTINCT id, shash FROM function_records WHERE len(toks) >= 40 AND shash IS NOT NULL), n AS (SELECT shash, count(*) AS members FROM l GROUP BY shash HAVING count(*) > 1) SELECT l.id, l.shash, n.members FROM l JOIN n ON l.shash = n.shash",
    "structure_hash": f"WITH {_FN} SELECT id, sha256(array_to_string(toks, chr(31))) AS hash, CAST(len(toks) AS BIGINT) AS tokens FROM f WHERE toks IS NOT NULL",
    "pair_buckets": f"WITH {_P} SELECT {_B} AS bucket, count(*) AS pairs FROM p GROUP BY 1",
    "duplicate_pairs": f"WITH {_P} SELECT pair, jaccard FROM p WHERE coalesce(structural_match, false) OR (coalesce(jaccard >= 0.7, false) AND coalesce(sig_gate, false))",
    "signature_scores": f"WITH {_FN}, q AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM candidate_pairs WHERE a_id <> b_id), j AS (SELECT q.a_id, q.b_id, list_distinct(coalesce(a.callees, [])) AS ca, list_distinct(coalesce(b.callees, [])) AS cb, a.param_count AS pa, b.param_count AS pb, a.returns_value AS ra, b.returns_value AS rb, a.is_async AS aa, b.is_async AS ab FROM q JOIN f a ON q.a_id = a.id JOIN f b ON q.b_id = b.id) SELECT a_id, b_id, round(0.6 * CASE WHEN len(ca) + len(cb) = 0 THEN 1.0 ELSE CAST(len(list_intersect(ca, cb)) AS DOUBLE) / (len(ca) + len(cb) - len(list_intersect(ca, cb))) END + CASE WHEN pa = pb THEN 0.2 ELSE 0.0 END + CASE WHEN ra = rb THEN 0.1 ELSE 0.0 END + CASE WHEN aa = ab THEN 0.1 ELSE 0.0 END, 6) AS score FROM j",
    "precision_recall_sweep": f"WITH {_SWEEP} SELECT threshold, predicted, hits, actual, precision, recall FROM w",
    "chosen_threshold": f"WITH {_SWEEP} SELECT max(threshold) AS threshold, arg_max(precision, threshold) AS precision FROM w WHERE recall >= 0.9",
    "weighted_precision": f"WITH {_P}, b AS (SELECT {_B} AS stratum, sig_gate FROM p), e AS (SELECT stratum, avg(CASE WHEN sig_gate THEN 1.0 ELSE 0.0 END) AS pr FROM b WHERE sig_gate IS NOT NULL GROUP BY stratum), n AS (SELECT stratum, count(*) AS n FROM b GROUP BY stratum) SELECT round(sum(pr * n) / sum(n), 6) AS precision, count(*) AS strata FROM e JOIN n USING (stratum)",
    "gate_breakdown": f"WITH {_P} SELECT {_B} AS bucket, count(*) FILTER (WHERE sig_gate) AS yes, count(*) FILTER (WHERE NOT sig_gate) AS no, count(*) FILTER (WHERE sig_gate IS NULL) AS unknown FROM p GROUP BY 1",
    "pairs_not_nested": f"WITH {_FN}, q AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM candidate_pairs WHERE a_id <> b_id) SELECT a_id, b_id FROM q JOIN f a ON a_id = a.id JOIN f b ON b_id = b.id WHERE NOT coalesce(a.file = b.file AND (b.start_line BETWEEN a.start_line AND a.end_line OR a.start_line BETWEEN b.start_line AND b.end_line), false)",
    "first_pairs": f"WITH {_P} SELECT pair, coalesce(structural_match, false) AS structural_match, jaccard FROM p ORDER BY coalesce(structural_match, false) DESC, jaccard DESC NULLS LAST, pair LIMIT 100",
    "pair_degrees": "WITH r AS (SELECT a_id AS x, b_id AS y FROM candidate_pairs WHERE structural_match AND a_id <> b_id UNION SELECT b_id, a_id FROM candidate_pairs WHERE structural_match AND a_id <> b_id) SELECT x AS id, count(*) AS links FROM r GROUP BY x",
}

_RENAME = r"CASE WHEN n = '' THEN {0} ELSE regexp_replace({0}, '\b' || n || '\b', n || 'Planted', 'g') END"
_LITERALS = r"regexp_replace(regexp_replace({0}, '\b[0-9]+\b', '41', 'g'), '''[^''\n]*''', '''planted''', 'g')"
_INSERT = r"regexp_replace({0}, '^([^\n]*\n)', '\1  plantedCall(plantedValue, 1);' || chr(10))"
_EDITS = {"rename": _RENAME.format("source"), "insert": _INSERT.format("source"), "literals": _LITERALS.format("source"), "combined": _INSERT.format(_LITERALS.format(_RENAME.format("source")))}
_RUNS = "CASE WHEN len({0}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({0}) - 1, 2)), lambda i: array_to_string({0}[i:i + 2], chr(31)))) END"

ORACLE_SQL["planted_recall"] = (
    rf"WITH f AS (SELECT DISTINCT id, source, regexp_extract(source, '{E.LOCAL}', 1) AS n FROM function_records WHERE id IS NOT NULL AND source IS NOT NULL), "
    f"c AS ({' UNION ALL '.join(f'SELECT source, {k!r} AS kind, {e} AS planted FROM f' for k, e in _EDITS.items())}), "
    "w AS (SELECT kind, regexp_extract_all(lower(source), '[a-z0-9_]+') AS a, regexp_extract_all(lower(planted), '[a-z0-9_]+') AS b FROM c WHERE planted <> source), "
    f"s AS (SELECT kind, {_RUNS.format('a')} AS a, {_RUNS.format('b')} AS b FROM w), "
    "j AS (SELECT kind, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM s) "
    "SELECT kind, count(*) AS n, round(avg(CASE WHEN u = 0 OR i / u >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM j GROUP BY kind"
)
