"""DuckDB SQL for the queries whose whole result SQL can state."""
from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _low(x: str) -> str:
    return _LOWER.format(x)


LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS ls FROM d WHERE text <> '')),
n AS (SELECT doc_id, i, raw, t, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS nw FROM (SELECT *, {_low("trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13))")} AS t FROM l)),
m AS (SELECT *, lead(t, 1) OVER p AS t1, lead(t, 2) OVER p AS t2, lead(nw, 1) OVER p AS nw1 FROM n WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
w AS (
  SELECT doc_id, i, 3 AS n, t || chr(10) || t1 || chr(10) || t2 AS w FROM m WHERE t || t1 || t2 <> ''
  UNION ALL SELECT doc_id, i, 2, t || chr(10) || t1 FROM m WHERE nw + nw1 >= 50
  UNION ALL SELECT doc_id, i, 1, t FROM m WHERE nw >= 50),
r AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, w ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i, TRUE AS gone FROM r WHERE k > 1),
k AS (
  SELECT n.doc_id, count(*) AS n_lines, count(gone) AS n_removed, string_agg(raw, chr(10) ORDER BY n.i) FILTER (gone IS NULL) AS kept
  FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(CASE WHEN kept IS NULL THEN '' WHEN right(text, 1) = chr(10) THEN kept || chr(10) ELSE kept END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
x AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS x FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(x, ' ') AS s FROM x WHERE len(x) = 3 OR p = 1),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * i.n >= 90 * (x.n + y.n - i.n)),
r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _words(relation: str, key: str) -> str:
    return f"SELECT {key}, regexp_extract_all({_low("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {relation}"


DECONTAMINATION = f"""
WITH dw AS ({_words("documents", "doc_id")}),
bw AS ({_words("benchmark", "item_id")}),
v AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS w
  FROM (SELECT item_id, unnest(CASE WHEN len(ws) <= 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda s: ws[s:s + 9]) END) AS x
        FROM bw WHERE len(ws) > 0 AND item_id IS NOT NULL)),
lens AS (SELECT DISTINCT n FROM v),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM dw),
x AS (SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x FROM t),
f AS (SELECT doc_id, p, n, array_to_string(x[1:n], ' ') AS w FROM x JOIN lens ON len(x) >= n),
h AS (SELECT doc_id, p, n, item_id FROM f JOIN v USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER p AS keep_id, count(*) OVER p AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW p AS (PARTITION BY t)
"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS ls, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(ls) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, ls,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
x AS (SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM x
"""

ORACLES = {"op1_line_dedup": LINE_DEDUP, "op3_ngram_join": NGRAM_JOIN, "op5_decontamination": DECONTAMINATION, "op11_exact_dedup": EXACT_DEDUP, "op13_fill_in_middle": FILL_IN_MIDDLE}
