"""The queries in SQL for DuckDB, where SQL can express them in reasonable time.

Not expressed: op1 (no XXH64), op3 (keyed permutations), op5 (a trained model),
op6 (a tokenizer and a search) and op9 (a row for each byte of the corpus).
These are tested against brute force, or held-out accuracy, instead.
"""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT line, min((doc_id, line_no)) AS first, length(line) AS n FROM l WHERE length(line) >= 1 GROUP BY line),
e AS (SELECT line, first, n, left(line, n // 2) AS p, substring(line, n // 2 + 1) AS q, left(line, (n - 1) // 2) AS p1, substring(line, (n - 1) // 2 + 2) AS q1 FROM f WHERE n >= 20),
c AS (
SELECT a.line AS a, b.line AS b, a.first AS fa, b.first AS fb FROM e a JOIN e b ON a.n = b.n AND a.p = b.p AND a.line < b.line
UNION SELECT a.line, b.line, a.first, b.first FROM e a JOIN e b ON a.n = b.n AND a.q = b.q AND a.line < b.line
UNION SELECT a.line, b.line, a.first, b.first FROM e a JOIN e b ON a.n + 1 = b.n AND a.p = b.p1
UNION SELECT a.line, b.line, a.first, b.first FROM e a JOIN e b ON a.n + 1 = b.n AND a.q = b.q1),
v AS (SELECT *, coalesce(list_max(list_filter(range(0, length(a) + 1), lambda i: left(a, i) = left(b, i))), 0) AS k FROM c),
near AS (SELECT CASE WHEN fa < fb THEN b ELSE a END AS line FROM v WHERE CASE WHEN length(a) = length(b) THEN substring(a, k + 2) = substring(b, k + 2) ELSE substring(a, k + 1) = substring(b, k + 2) END),
g AS (SELECT l.doc_id, l.line_no, (l.line IN (SELECT line FROM near) OR (l.doc_id, l.line_no) <> f.first) AS gone FROM l JOIN f ON f.line = l.line),
r AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE coalesce(gone, false)) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE NOT coalesce(gone, false)), '') AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM r
"""

OP4 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
x AS (SELECT d.doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m) d),
h AS (SELECT x.doc_id, x.k, x.m, p.item_id FROM x JOIN p ON p.m = x.m AND p.s = x.s),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY s HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT x.doc_id, unnest(range(k, k + 13)) AS j FROM x JOIN f ON f.s = x.s WHERE f.first < x.doc_id) GROUP BY doc_id),
r AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
m AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM r)),
n AS (SELECT m.doc_id, string_agg(word, ' ' ORDER BY m.j) AS kept FROM m ANTI JOIN (SELECT doc_id, unnest(gone) AS j FROM r) q ON q.doc_id = m.doc_id AND q.j = m.j GROUP BY m.doc_id)
SELECT r.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r LEFT JOIN n ON n.doc_id = r.doc_id
"""

OP8 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, len(list_filter(range(1, len(q.b) + 1), lambda i: q.b[i] <> n.b[i])) AS distance FROM e q JOIN e n ON n.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 10
"""

OP10 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^~<\\[\\]]', '', 'g')) + 9 AS n FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM a
"""

SQL = {"op2_line_dedup": OP2, "op4_benchmark_decontamination": OP4, "op7_substring_dedup": OP7, "op8_exact_topk_search": OP8, "op10_chat_formatting": OP10}
