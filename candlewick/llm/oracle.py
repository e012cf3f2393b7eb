"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from candlewick.llm.oracle_merkle import merkle_sql

#: The six ASCII blanks, for ``trim``.
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""
WITH line AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents),
keyed AS (
    SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM line),
shared AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
    SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS gone
    FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_BLANK_CLASS = r"[\x20\x09-\x0D]"

_OP5 = f"""
WITH RECURSIVE base AS (
    SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '{_BLANK_CLASS}+'),
                               lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w]
           ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) END AS s FROM base),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
shingle AS (SELECT doc_id, unnest(s) AS g FROM sets),
held AS (SELECT g FROM shingle GROUP BY g HAVING count(*) > 1),
pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE a.g IN (SELECT g FROM held) GROUP BY a.doc_id, b.doc_id),
link AS (
    SELECT a, b FROM pair JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
    WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
    SELECT a AS doc_id, b AS other FROM both_ways
    UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(l.m, s.doc_id) AS kept
FROM sized s LEFT JOIN least l USING (doc_id)
"""

_OP7 = """
WITH sized AS (
    SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source),
rated AS (
    SELECT source, (SELECT sum(size) FROM sized) * pow(size, 0.7)
           / (SELECT sum(pow(size, 0.7)) FROM sized) / size AS rate FROM sized),
parted AS (SELECT source, rate, greatest(ceil(rate / 32), 1)::INT AS pieces FROM rated),
step AS (
    SELECT source, k, sum(exp(-(rate / pieces) + k * ln(rate / pieces) - lgamma(k + 1)))
           OVER (PARTITION BY source ORDER BY k) AS f
    FROM parted, unnest(range(0, 150)) AS t(k)),
drawn AS (
    SELECT d.doc_id, d.source, d.text,
           ('0x' || substr(md5('7:' || d.doc_id || ':' || piece), 1, 13))::BIGINT / pow(2, 52) AS u
    FROM documents d JOIN parted p ON d.source IS NOT DISTINCT FROM p.source,
         unnest(range(1, p.pieces + 1)) AS t(piece)),
counted AS (
    SELECT doc_id, any_value(d.source) AS source, any_value(d.text) AS text,
           count(*) FILTER (s.f <= d.u) AS n
    FROM drawn d JOIN step s ON d.source IS NOT DISTINCT FROM s.source GROUP BY doc_id)
SELECT doc_id, source, copy, text FROM counted, unnest(range(1, n + 1)) AS t(copy)
"""

_OP8 = f"""
WITH base AS (
    SELECT doc_id, source, coalesce(text, '') AS body,
           list_filter(string_split_regex(coalesce(text, ''), '{_BLANK_CLASS}+'), lambda x: x <> '') AS w
    FROM documents),
windows AS (
    SELECT doc_id, i, w[i:i + 4] AS win
    FROM base, unnest(range(1, greatest(len(w) - 3, 1))) AS t(i)),
repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows)
    WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM repeated, unnest(range(i, i + 5)) AS t(p) GROUP BY doc_id),
line AS (
    SELECT doc_id, source, body, unnest(string_split(body, chr(10))) AS line,
           unnest(range(len(string_split(body, chr(10))))) AS pos
    FROM base),
norm AS (
    SELECT *, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key,
           length(regexp_replace(line, '{_BLANK_CLASS}', '', 'g')) AS chars
    FROM line WHERE trim(line, {_BLANKS}) <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM norm GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT body) AS docs FROM base GROUP BY source),
over_limit AS (
    SELECT n.source, n.key, min(n.doc_id) AS first
    FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source
    GROUP BY n.source, n.key, h.docs
    HAVING count(DISTINCT n.body) > 20 AND count(DISTINCT n.body) > 0.05 * h.docs),
gone AS (
    SELECT n.doc_id, sum(n.chars) AS chars
    FROM norm n JOIN over_limit o ON n.source IS NOT DISTINCT FROM o.source AND n.key = o.key
    WHERE n.doc_id <> o.first GROUP BY n.doc_id),
measured AS (
    SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
           coalesce(g.chars, 0)::BIGINT AS over_chars
    FROM base b LEFT JOIN dup d USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN gone g USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND word_chars - over_chars >= 0.3 * word_chars AS kept
FROM measured
"""

ORACLE: dict[str, str] = {
    "op4_line_dedup": _OP4,
    "op5_near_duplicates": _OP5,
    "op7_mix_sources": _OP7,
    "op8_quality_rules": _OP8,
    "op12_merkle_manifest": merkle_sql(),
}
