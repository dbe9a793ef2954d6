"""SQL for DuckDB with the results of the operators that SQL can express."""

from __future__ import annotations

from .chat_format import ORACLE_SQL as CHAT_FORMAT
from .decontaminate import LOWER, SEPARATORS, UPPER, WINDOW
from .filter_audit import ORACLE_SQL as FILTER_AUDIT
from .line_dedup import ORACLE_SQL as LINE_DEDUP
from .vector_codes import ORACLE_SQL as VECTOR_CODES

QUALITY = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, k, w[k] || chr(10) || w[k + 1] || chr(10) || w[k + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM t WHERE len(w) >= 3)),
o AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS pos FROM o WHERE c > 1) GROUP BY 1),
m AS (SELECT t.doc_id, x, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
  length(regexp_replace(x, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(x, '[^\p{Lu}]', '', 'g')) AS capitals,
  (length(x) - length(replace(x, '!!', ''))) / 2 AS shouts, (length(x) - length(replace(x, '...', ''))) / 3 + length(x) - length(replace(x, '…', '')) AS dots
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN r ON t.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols * 10 > n_words OR (n_lines >= 4 AND n_dup_lines * 10 > 3 * n_lines) OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (letters > 0 AND capitals * 2 > letters) OR letters * 2 < word_chars OR shouts * 10 > n_words OR dots * 10 > n_words) AS kept
FROM b
"""

NEAR_DEDUP = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
f AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM t UNION SELECT r.node, f.y FROM r JOIN f ON r.reach = f.x),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN c ON c.node = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
""" % (UPPER, LOWER)


def _words(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM {table}"


DECONTAMINATE = f"""
WITH d AS ({_words("documents", "doc_id")}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({WINDOW}, len(w)) AS size FROM ({_words("benchmark", "item_id")}) WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM b)),
y AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS s FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM x) WHERE len(w) >= size)),
h AS (SELECT doc_id, item_id, k, y.size FROM y JOIN x ON x.s = y.s AND x.size = y.size),
p AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(p.n, 0) > 0 AND 20 * coalesce(p.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""

ORACLE_SQL = {"op3_quality": QUALITY, "op5_near_dedup": NEAR_DEDUP, "op7_line_dedup": LINE_DEDUP, "op8_decontaminate": DECONTAMINATE, "op11_filter_audit": FILTER_AUDIT, "op12_vector_codes": VECTOR_CODES, "op13_chat_format": CHAT_FORMAT}
