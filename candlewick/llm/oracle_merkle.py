"""DuckDB SQL of the Merkle manifest: the levels of a tree written out one after the other."""

from __future__ import annotations

#: Levels of a language's tree, enough for 8**7 rows, and of the tree of languages.
_LEVELS, _LANGUAGE_LEVELS = 7, 3
_FIELDS = ("source", "lang", "n_chars")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", *_FIELDS, text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 bit by bit: a byte enters at the first of its eight steps.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    string_split(coalesce(doc_id::VARCHAR, ''), ''),
    lambda x: [CASE WHEN x = '' THEN 0 ELSE ascii(x) END::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def _tree(name: str, first: str, key: str, levels: int) -> str:
    """``<name>_<k>`` are the nodes of level k, ``<name>_s<k>`` what lies left and right of a node in its run."""
    parts = [f"{name}_0 AS MATERIALIZED ({first})"]
    for k in range(levels):
        parts.append(f"""{name}_{k + 1} AS MATERIALIZED (
    SELECT {key}, pos // 8 AS pos, (n + 7) // 8 AS n,
           CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
    FROM {name}_{k} GROUP BY {key}, pos // 8, n)""")
        parts.append(f"""{name}_s{k} AS MATERIALIZED (
    SELECT a.{key}, a.pos, a.n > 1 AS folds,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name}_{k} a JOIN {name}_{k} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.pos // 8 = b.pos // 8
    GROUP BY a.{key}, a.pos, a.n)""")
    return ",\n".join(parts)


def _climb(source: str, tree: str, key: str, levels: int, place: str) -> tuple[str, str]:
    """Steps that extend ``proof`` and fold ``folded`` by the levels of a tree, and the name of the last one."""
    parts, last = [], source
    for k in range(levels):
        step = f"{tree}_up{k}"
        parts.append(f"""{step} AS (
    SELECT x.* EXCLUDE (proof, folded), x.proof || CASE WHEN s.folds THEN s.l || s.r ELSE '' END AS proof,
           CASE WHEN s.folds THEN sha256(s.l || x.folded || s.r) ELSE x.folded END AS folded
    FROM {last} x JOIN {tree}_s{k} s ON x.{key} IS NOT DISTINCT FROM s.{key} AND s.pos = x.{place} // {8**k})""")
        last = step
    return ",\n".join(parts), last


def merkle_sql() -> str:
    leaves = f"""
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, altered NULLS FIRST) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n, leaf AS node, altered
    FROM (SELECT doc_id, lang, {_leaf("text")} AS leaf,
                 CASE WHEN {_CRC} % 3 = 0 AND {_LOWER} <> text THEN {_leaf(_LOWER)} END AS altered FROM documents)"""
    tops = f"""
    SELECT 0 AS one, lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM leaf_{_LEVELS}"""
    climb, end = _climb("begin", "leaf", "lang", _LEVELS, "pos")
    climb_root, root_end = _climb("middle", "top", "one", _LANGUAGE_LEVELS, "place")
    return f"""
WITH {_tree("leaf", leaves, "lang", _LEVELS)},
{_tree("top", tops, "one", _LANGUAGE_LEVELS)},
begin AS (SELECT doc_id, lang, pos, node AS leaf, coalesce(altered, node) AS folded, '' AS proof FROM leaf_0),
{climb},
middle AS (
    SELECT e.*, t.node AS subroot, t.pos AS place, t.one FROM {end} e JOIN top_0 t ON e.lang IS NOT DISTINCT FROM t.lang),
{climb_root}
SELECT e.doc_id, e.leaf, e.subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root,
       e.folded = r.node AS verified
FROM {root_end} e CROSS JOIN top_{_LANGUAGE_LEVELS} r
"""
