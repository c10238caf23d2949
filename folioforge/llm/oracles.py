"""DuckDB SQL for the operators SQL can express, written from what they promise and not from how they work."""

from __future__ import annotations

from folioforge.llm.license_scan import PHRASES, TEMPLATES

OP1 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+7]) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(g) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice) GROUP BY doc_id),
raw AS (SELECT doc_id, source, md5(t) AS tk, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM d),
norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '\p{N}+', '0', 'g'), '[^\p{L}\p{M}0]+', ' ', 'g')) AS x FROM raw),
host AS (SELECT source, count(*) AS n FROM (SELECT DISTINCT source, doc_id, text FROM documents) GROUP BY source),
bad AS (SELECT source, x FROM (SELECT source, x, count(DISTINCT (doc_id, tk)) AS n FROM norm WHERE x <> '' GROUP BY ALL) l JOIN host h USING (source) WHERE l.n > 10 AND l.n > 0.05 * h.n),
gone AS (SELECT doc_id, coalesce(sum(len(string_split(x, ' '))) FILTER (WHERE x <> ''), 0) AS total, coalesce(sum(len(string_split(n.x, ' '))) FILTER (WHERE b.x IS NOT NULL), 0) AS removed, coalesce(string_agg(raw, chr(10) ORDER BY ln) FILTER (WHERE b.x IS NULL), '') AS clean FROM norm n LEFT JOIN bad b USING (source, x) GROUP BY doc_id),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words, coalesce(total, 0) AS total, CASE WHEN removed > 0 THEN clean ELSE text END AS clean FROM w JOIN documents USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (removed_words > 0 AND total - removed_words < 0.3 * total) AS kept, removed_words, sha256(clean) AS clean_sha256 FROM b
"""

OP5 = r"""
WITH p AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS ln FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos FROM (SELECT *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l) WHERE s <> ''),
c AS (SELECT *, sum(len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS ends, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM f),
d AS (SELECT doc_id, list(s ORDER BY pos) AS lines FROM c GROUP BY doc_id),
w AS (SELECT a.doc_id, a.pos AS first, min(b.pos) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.ends >= a.ends - a.n + 50 GROUP BY ALL
UNION SELECT a.doc_id, max(b.pos) AS first, a.pos AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND b.ends - b.n <= a.ends - 50 GROUP BY a.doc_id, a.pos),
k AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY md5(array_to_string(lines[first:last], chr(10))) ORDER BY doc_id, first) AS place FROM w JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM k WHERE place > 1),
q AS (SELECT f.doc_id, f.ln, g.pos IS NOT NULL AS gone FROM f LEFT JOIN g USING (doc_id, pos)),
o AS (SELECT l.doc_id, l.ln, l.raw, coalesce(q.gone, coalesce(last_value(q.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln), FALSE) AND coalesce(first_value(q.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), FALSE)) AS gone FROM l LEFT JOIN q USING (doc_id, ln))
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(n.g, 0) AS BIGINT) AS n_removed, sha256(CASE WHEN coalesce(n.g, 0) = 0 THEN t.text ELSE coalesce(o.text, '') END) AS text_sha256
FROM documents t LEFT JOIN (SELECT doc_id, count(*) AS n, count_if(gone) AS g FROM q GROUP BY doc_id) n USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY ln) AS text FROM o WHERE NOT gone GROUP BY doc_id) o USING (doc_id)
"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM k WHERE k.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

_TEMPLATES = ", ".join(f"({n}, '{label}', {2 if n < len(PHRASES) else 4}, string_split('{words}', ' '))" for n, (label, words) in enumerate((*PHRASES, *TEMPLATES)))
OP4 = rf"""
WITH t(template, label, k, words) AS (VALUES {_TEMPLATES}),
tg AS (SELECT template, label, k, len(words) AS length, p, array_to_string(words[p:p+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(words) - k + 2)) AS p FROM t)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (2), (4)) AS v(k) WHERE len(w) >= k)),
h AS (SELECT doc_id, template, label, length, tg.k AS k, p, i, i - p AS d FROM dg JOIN tg USING (k, g)),
x AS (SELECT doc_id, label, TRUE AS phrase, d AS first, 1.0 AS share FROM h WHERE template < {len(PHRASES)} GROUP BY doc_id, template, label, length, k, d HAVING count(DISTINCT p) = length - k + 1),
b AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, template ORDER BY d) AS band FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= 3 THEN 0 ELSE 1 END AS o FROM h WHERE template >= {len(PHRASES)})),
y AS (SELECT doc_id, label, FALSE AS phrase, min(i) AS first, count(DISTINCT q) / length AS share FROM (SELECT *, unnest(range(p, p + k)) AS q FROM b) GROUP BY doc_id, template, label, length, band HAVING count(DISTINCT q) / length >= 0.6),
s AS (SELECT * FROM x UNION ALL SELECT * FROM y)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(count_if(phrase), 0) AS BIGINT) AS n_base, CAST(min(first) FILTER (WHERE phrase) AS BIGINT) AS first_word, CAST(max(first) FILTER (WHERE phrase) AS BIGINT) AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(share), 0) AS DOUBLE) AS score
FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id, w
"""

_HASH = lambda k: f"CAST('0x' || substr(sha256('7:' || doc_id), {8 * k + 1}, 8) AS BIGINT)"
OP12 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {", ".join(f"{_HASH(k)} AS h{k + 1}" for k in range(4))} FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13 = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
d AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM g) ks ON len(w) >= k)),
h AS (SELECT doc_id, item_id, k, i FROM x JOIN g USING (k, g)),
q AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS pos FROM h),
n AS (SELECT doc_id, count(*) AS n_hit FROM q GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY doc_id),
e AS (SELECT doc_id, string_split(regexp_replace(text, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS e FROM d WHERE doc_id IN (SELECT doc_id FROM n) AND NOT contains(text, chr(1))),
c AS (SELECT e.doc_id, string_agg(e.e, '' ORDER BY e.j) AS clean FROM (SELECT doc_id, unnest(e) AS e, generate_subscripts(e, 1) AS j FROM e) e
LEFT JOIN q ON q.doc_id = e.doc_id AND q.pos * 2 = e.j LEFT JOIN q a ON a.doc_id = e.doc_id AND a.pos * 2 = e.j - 1 LEFT JOIN q z ON z.doc_id = e.doc_id AND z.pos * 2 = e.j + 1
WHERE q.pos IS NULL AND (e.j % 2 = 0 OR a.pos IS NULL OR z.pos IS NULL) GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
sha256(CASE WHEN n_hit IS NULL THEN text ELSE coalesce(clean, '') END) AS clean_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""

ORACLES = {"op1_quality_rules": OP1, "op4_license_scan": OP4, "op5_line_dedup": OP5, "op9_embedding_near_dedup": OP9, "op12_fill_in_middle": OP12, "op13_decontamination": OP13}
