"""SQL twins of import resolution, written from the order in which candidates are tried."""

from __future__ import annotations

from gritstone.operators.imports import DECLARATION, OUTPUT_TO_SOURCE, SOURCE_ENDINGS


def joined_sql(folder: str, relative: str) -> str:
    """A path joined and normalised; null above the root."""
    parts = f"list_filter(string_split({folder} || {relative}, '/'), lambda s: s NOT IN ('', '.'))"
    step = "CASE WHEN a = '!' OR a = '' AND s = '..' THEN '!' WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END"
    walked = f"list_reduce(list_prepend('', {parts}), lambda a, s: {step})"
    return f"CASE WHEN {walked} <> '!' THEN substr({walked}, 2) END"


def candidates_sql(asked: str, keys: str) -> str:
    """(keys, path, k): every path that may answer ``asked`` (keys, wanted), in the order they are tried."""
    out = [f"SELECT {keys}, wanted AS path, 0 AS k FROM {asked}"]
    for k, (output, source) in enumerate(OUTPUT_TO_SOURCE):
        out.append(f"SELECT {keys}, substr(wanted, 1, length(wanted) - {len(output)}) || '{source}', {k + 1} FROM {asked} WHERE ends_with(wanted, '.{output}')")
    for k, ending in enumerate(SOURCE_ENDINGS):
        out.append(f"SELECT {keys}, wanted || '.{ending}', {11 + k} FROM {asked}")
        out.append(f"SELECT {keys}, wanted || '/index.{ending}', {21 + k} FROM {asked}")
    return " UNION ALL ".join(out)


def modules_sql(files: str = "files") -> str:
    return rf"SELECT DISTINCT rel FROM {files} WHERE rel IS NOT NULL AND NOT regexp_matches(rel, '{DECLARATION}')"


def resolver_sql(edges: str) -> str:
    """Common table expressions that end in ``resolved`` (edge_id, target) of relative specifiers of ``edges``."""
    folder = "regexp_replace(from_rel, '[^/]*$', '')"
    return (
        f"rq AS (SELECT edge_id, {joined_sql(folder, 'specifier')} AS wanted FROM {edges} WHERE starts_with(specifier, '.') AND from_rel IS NOT NULL), "
        f"rc AS ({candidates_sql('rq', 'edge_id')}), rm AS ({modules_sql()}), "
        "rb AS (SELECT edge_id, arg_min(rel, k) AS target FROM rc JOIN rm ON rc.path = rm.rel GROUP BY edge_id), "
        "resolved AS (SELECT rq.edge_id AS edge_id, rb.target AS target FROM rq LEFT JOIN rb ON rq.edge_id = rb.edge_id)"
    )
