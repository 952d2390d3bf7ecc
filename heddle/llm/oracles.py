"""DuckDB SQL for the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

from .mixing import DRAW_DIGITS, EPOCHS, SEED, SHARE

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', {SEED}, doc_id)), 1, {DRAW_DIGITS}))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, {EPOCHS}::DOUBLE * source_size AS cap, {EPOCHS}::DOUBLE * source_size / weight AS full_at, sum(source_size) OVER ()::DOUBLE * {SHARE}::DOUBLE AS total FROM r),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT min_by(level, full_at) AS free FROM v WHERE full_at > level * (1 + 1e-12)),
t AS (SELECT source, source_size, CASE WHEN full_at <= level * (1 + 1e-12) THEN cap ELSE least(cap, weight * (SELECT free FROM f)) END AS target FROM v),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS whole FROM t),
x AS (SELECT d.*, w.source_size, w.target, w.whole, greatest(0, w.target - w.whole * w.source_size) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.draw) AS at_draw
      FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
c AS (SELECT source, max(draw) AS cut FROM x WHERE upto - rest <= rest - (upto - at_draw) GROUP BY source)
SELECT x.doc_id, x.size, x.source_size, x.target, ((x.whole + CASE WHEN x.draw <= c.cut THEN 1 ELSE 0 END) * x.size)::BIGINT AS taken
FROM x LEFT JOIN c ON x.source IS NOT DISTINCT FROM c.source
"""

OP4 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256 FROM d
"""


OP1 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
b AS (
  SELECT doc_id, text, words, len(words) AS n_words,
         length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS filled,
         len(string_split(text, chr(10))) AS n_lines, text AS t FROM d),
u AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, n_words)) AS pos FROM b),
p AS (SELECT doc_id, pos, word || ' ' || """ + " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, 8)) + r""" AS win
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p WHERE win IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(pos, pos + 7)) AS q FROM w WHERE n > 1) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_distinct FROM (SELECT DISTINCT doc_id, (pos - 1) // 1000 AS stretch, word FROM u) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         (len(filled) - len(list_distinct(filled)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed, text, words, n_lines, coalesce(n_distinct, 0) AS n_distinct,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (
         n_symbols > 0.10 * n_words
         OR len(regexp_extract_all(text, '[#*$%&]{2,}')) > 0.05 * n_words
         OR len(regexp_extract_all(text, '!{2,}')) > 0.10 * n_words
         OR length(text) - length(replace(text, '|', '')) > 0.10 * n_words
         OR n_upper > 0.50 * n_letters
         OR word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words
         OR n_dup_lines > 0.60 * n_lines
         OR len([i FOR i IN generate_series(2, n_words) IF words[i] = words[i - 1]]) > 0.25 * n_words
         OR n_distinct < 0.15 * n_words
         OR len([x FOR x IN words IF NOT regexp_matches(x, '\p{L}')]) > 0.40 * n_words
         OR len(regexp_extract_all(text, 'https?://|www\.')) > 0.10 * n_words) AS kept
FROM f
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
k AS (SELECT item, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS pos FROM i WHERE len(words) > 0),
w AS (SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[pos:pos + 9], ' ') AS win FROM k),
s AS (SELECT DISTINCT size FROM w),
x AS (SELECT row, size, words, unnest(generate_series(1, len(words) - size + 1)) AS pos FROM d, s WHERE len(words) >= size),
o AS (SELECT row, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS win FROM x),
h AS (SELECT o.row, o.pos, o.size, w.item FROM o JOIN w USING (size, win)),
n AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(generate_series(pos, pos + size - 1)) AS q FROM h) GROUP BY row),
t AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row) LEFT JOIN t USING (row)
"""

OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM u GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM u GROUP BY lang, source, term),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, l.v, k.n AS lang_n, l.total AS lang_total
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p,
        1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS q FROM x),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
y AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words),
         'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
         'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS f FROM t LEFT JOIN y USING (doc_id)),
h AS (SELECT part, f.A AS a, f.B AS b, f.C AS c, f.D AS d, f.E AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
m AS (SELECT part, n, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END,
        CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM h),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS step)),
r AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS solely,
        length(translate(fails, before, '')) < length(fails) AS gone FROM m, s),
z AS (SELECT part, filter_order, step::INT AS step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN solely THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op2_mixing": OP2, "op4_exact_dedup": OP4, "op11_decontamination": OP11, "op12_source_divergence": OP12, "op13_filter_interaction": OP13}
