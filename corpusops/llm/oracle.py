"""DuckDB SQL of the training-data queries that SQL can express over the whole tables."""

from __future__ import annotations

from corpusops.plans.registry import nfkc_sql

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
# Fixed values, kept apart from the operator's: letters that look like the Latin ones below them.
_LETTERS = "аАВсСеЕНһіІјЈКМоОрРѕЅТхХуУԁԛԚԝԜѵӏӀΑΒΕΖΗΙΚΜΝνοΟρΡΤΥΧϲϳհոսօՍՕёЁ"
_LATIN = "aABcCeEHhiIjJKMoOpPsSTxXyYdqQwWvlIABEZHIKMNvoOpPTYXcjhnuoUOëË"
_FROM, _TO = _LETTERS + _WIDE + "‐‑", _LATIN + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + "--"


def form_sql(text: str) -> str:
    """The consistent form of a text, but for the letters given back to words of other scripts."""
    out = rf"regexp_replace({text}, '[\p{{Cf}}\x{{34F}}\x{{FE00}}-\x{{FE0F}}]', '', 'g')"
    out = rf"regexp_replace({out}, '\p{{Zs}}', ' ', 'g')"
    for wide, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("\r\n", "\n"), ("\r", "\n")):
        out = f"replace({out}, '{wide}', '{plain}')"
    quoted = _TO.replace("'", "''")
    return f"nfc_normalize(translate(nfc_normalize({out}), '{_FROM}', '{quoted}'))"


def _label(c: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({nfkc_sql(c)}), '[^\p{{L}}\p{{N}}]+', '', 'g'), 's$', '')"


_P2 = rf"""
b AS (SELECT final_id AS id, {_label('source')} AS src, coalesce({_label('source_subtype')}, '') AS sub, coalesce(len(condition_input_ids), 0) + coalesce(len(input_ids), 0) AS tokens FROM final_rows WHERE final_id IS NOT NULL AND source IS NOT NULL),
t AS (SELECT *, row_number() OVER (ORDER BY mix_name, source, coalesce(source_subtype, '')) AS target, {_label('source')} AS t_src, {_label('source_subtype')} AS t_sub FROM mix_targets WHERE mix_name IS NOT NULL AND source IS NOT NULL),
c AS (SELECT * FROM (SELECT mix_name, src, sub, target, row_number() OVER (PARTITION BY mix_name, src, sub ORDER BY t_sub IS NULL, target) AS rn FROM (SELECT DISTINCT src, sub FROM b) JOIN t ON src = t_src AND (t_sub IS NULL OR t_sub = sub)) WHERE rn = 1),
r AS (SELECT c.target, b.id, b.tokens, CAST('0x' || substr(md5('17|' || b.id), 1, 15) AS BIGINT) AS h FROM b JOIN c USING (src, sub)),
z AS (SELECT target, CAST(sum(tokens) AS BIGINT) AS size, count(*) AS n FROM r GROUP BY target),
l AS (SELECT t.*, z.size, z.n, target_share / sum(target_share) OVER (PARTITION BY mix_name) AS scaled FROM t JOIN z USING (target) WHERE target_share > 0 AND max_repeats > 0 AND size > 0),
m AS (SELECT *, min(size * max_repeats / scaled) OVER (PARTITION BY mix_name) AS total FROM l),
p AS (SELECT *, scaled * total AS need, greatest(4096, CAST(ceil(floor(total) / 65536) AS BIGINT)) AS slots, coalesce(sum(scaled) OVER (PARTITION BY mix_name ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, row_number() OVER (PARTITION BY mix_name ORDER BY target DESC) = 1 AS tail FROM m),
g AS (SELECT mix_name, slot, (slot + 1) * 0.6180339887498949::DOUBLE - floor((slot + 1) * 0.6180339887498949::DOUBLE) AS u FROM (SELECT mix_name, unnest(range(0, any_value(slots))) AS slot FROM p GROUP BY mix_name)),
k AS (SELECT target, slot, row_number() OVER (PARTITION BY target ORDER BY slot) - 1 AS k, count(*) OVER (PARTITION BY target) AS blocks FROM g JOIN p USING (mix_name) WHERE u >= low AND (tail OR u < low + scaled)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY target ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
e AS (SELECT s.*, p.mix_name, p.need, p.size, unnest(range(0, least(p.max_repeats, greatest(1, CAST(ceil(p.need / p.size) AS INT))))) AS repeat_no FROM s JOIN p USING (target)),
a AS (SELECT *, repeat_no * size + before AS place FROM e WHERE repeat_no * size + before + tokens / 2 <= need),
placed AS (SELECT a.*, k.slot, CAST(floor(place - k.k * need / k.blocks) AS BIGINT) AS offset_in_slot FROM a JOIN (SELECT target, any_value(blocks) AS n FROM k GROUP BY target) w USING (target) JOIN k ON k.target = a.target AND k.k = least(floor(a.place * w.n / a.need), w.n - 1))"""

_WORDS_20 = "array_to_string(w[i:i+19], ' ')"
_P6 = rf"""
e AS (SELECT item_id, regexp_extract_all(lower({nfkc_sql(form_sql('question'))}), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM eval_items),
ew AS (SELECT DISTINCT item_id, {_WORDS_20} AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM e)),
d AS (SELECT doc_id, regexp_extract_all(lower({nfkc_sql(form_sql('text'))}), '[\p{{L}}\p{{N}}\p{{M}}]+') AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, {_WORDS_20} AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (x))"""


def _near(rows: str, pair: str) -> str:
    """Near-same pairs of distinct keys of rows(id, side, key), then of their rows under the condition ``pair``."""
    return f"""
WITH r AS ({rows}), k AS (SELECT key, min(id) AS rep FROM r GROUP BY key), t AS (SELECT rep, unnest(string_split(key, ' ')) AS w FROM k),
o AS (SELECT rep, w, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT rep, sum(c) AS n FROM o GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, sum(least(a.c, b.c)) AS s FROM o a JOIN o b ON a.w = b.w AND a.rep < b.rep GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.rep = x JOIN n v ON v.rep = y WHERE s / (u.n + v.n - s) >= 0.75), m AS (SELECT id, side, rep FROM r JOIN k USING (key)),
f AS (SELECT a.id AS i, b.id AS j FROM l JOIN m a ON a.rep = x JOIN m b ON b.rep = y WHERE {pair} UNION ALL SELECT a.id, b.id FROM m a JOIN m b ON a.rep = b.rep AND a.id < b.id WHERE {pair})
SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM f"""


def _linked(rows: str) -> str:
    """Tables up to l(x, y), the near-same pairs of distinct keys; r(id, side, key) and m(id, side, rep) as in _near."""
    return _near(rows, "true").split(", m AS")[0].strip()[5:]


_QUESTION = r"regexp_extract(input, '(?s)Question: (.*)\nAnswer:', 1)"
_FINAL = rf"SELECT final_id AS id, split = 'train' AS side, array_to_string(regexp_extract_all(lower({nfkc_sql(_QUESTION)}), '[a-z0-9]+(?:\.[0-9]+)?'), ' ') AS key FROM final_rows WHERE contains(input, 'Question: ')"
# Linked texts of different sides, both ways; windows of five words that both hold; the words in such windows.
_P1 = f"""{_linked(_FINAL)}, s AS (SELECT k.rep, r.side, count(*) AS size FROM r JOIN k USING (key) GROUP BY ALL), q AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
e AS (SELECT u.rep, u.side, v.rep AS other, v.size FROM q JOIN s u ON u.rep = x JOIN s v ON v.rep = y WHERE u.side <> v.side),
w AS (SELECT rep, string_split(key, ' ') AS w FROM k), g AS (SELECT rep, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rep, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT rep, side, count(DISTINCT i + j) AS covered FROM (SELECT e.rep, e.side, a.i, unnest(range(0, 5)) AS j FROM e JOIN g a ON a.rep = e.rep JOIN g b ON b.rep = e.other AND b.g = a.g) GROUP BY ALL),
z AS (SELECT s.rep, s.side, (SELECT coalesce(sum(size), 0) FROM s t WHERE t.rep = s.rep AND t.side <> s.side) AS same, (SELECT count(*) FROM e WHERE e.rep = s.rep AND e.side = s.side) AS links, (SELECT coalesce(sum(size), 0) FROM e WHERE e.rep = s.rep AND e.side = s.side) AS near FROM s),
records AS (SELECT r.id AS final_id, z.rep AS text_id, same > 0 AS copied, links, CAST(same + near AS BIGINT) AS pairs, round(CASE WHEN same > 0 THEN 1.0 ELSE coalesce(covered / len(w.w), 0.0) END, 6) AS coverage
 FROM r JOIN k USING (key) JOIN z ON z.rep = k.rep AND z.side = r.side JOIN w ON w.rep = k.rep LEFT JOIN c ON c.rep = z.rep AND c.side = z.side)"""
_PREPARED = "SELECT row_id AS id, true AS side, question_key AS key FROM prepared_rows WHERE question_key <> ''"

ORACLE = {
    "p1_found": f"SELECT id_a AS final_id_a, id_b AS final_id_b FROM ({_near(_FINAL, 'a.side <> b.side')})",
    "p1_records": f"WITH {_P1} SELECT * FROM records",
    "p1_report": f"WITH {_P1} SELECT split, lower(trim(source)) AS source, count(*) AS rows, count(records.pairs) AS overlapping_rows, CAST(coalesce(sum(records.pairs), 0) AS BIGINT) AS pairs, round(avg(coverage), 6) AS mean_coverage, round(count(records.pairs) / count(*), 6) AS overlapping_share FROM final_rows LEFT JOIN records ON records.final_id = final_rows.final_id AND records.pairs > 0 GROUP BY ALL",
    "p2_mix": f"WITH {_P2} SELECT placed.mix_name, slot, offset_in_slot, source, source_subtype, id AS final_id, CAST(repeat_no AS INT) AS repeat_no, tokens FROM placed JOIN t USING (target)",
    "p2_shares": f"WITH {_P2}, y AS (SELECT target, mix_name, count(*) AS rows, CAST(max(repeat_no) + 1 AS INT) AS most_repeats, CAST(sum(tokens) AS BIGINT) AS tokens FROM placed GROUP BY ALL) SELECT t.mix_name, t.source, t.source_subtype, coalesce(t.target_share, 0.0) AS target_share, coalesce(t.max_repeats, 1) AS max_repeats, coalesce(z.n, 0) AS rows_there, coalesce(z.size, 0) AS tokens_there, coalesce(y.rows, 0) AS rows, coalesce(most_repeats, 0) AS most_repeats, coalesce(y.tokens, 0) AS tokens, round(coalesce(p.scaled, 0.0), 6) AS scaled_share, round(coalesce(y.tokens / (SELECT sum(tokens) FROM y o WHERE o.mix_name = t.mix_name), 0.0), 6) AS reached_share FROM t LEFT JOIN z USING (target) LEFT JOIN y USING (target) LEFT JOIN p USING (target)",
    "p4_found": f"SELECT id_a AS row_id_a, id_b AS row_id_b FROM ({_near(_PREPARED, 'true')})",
    "p4_groups": f"""WITH RECURSIVE {_linked(_PREPARED)}, q AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
cc(n, m) AS (SELECT rep, rep FROM k UNION SELECT cc.n, q.y FROM cc JOIN q ON cc.m = q.x), roots AS (SELECT n, min(m) AS group_id FROM cc GROUP BY n)
SELECT r.id AS row_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, (SELECT count(*) FROM q WHERE q.x = k.rep) AS links FROM r JOIN k USING (key) JOIN roots ON roots.n = k.rep""",
    "p6_found": f"WITH {_P6} SELECT doc_id, item_id FROM found",
    "p6_report": f"WITH {_P6} SELECT suite, count(DISTINCT e.item_id) AS items, count(DISTINCT found.item_id) AS leaked_items, count(DISTINCT doc_id) AS documents FROM eval_items e LEFT JOIN found ON found.item_id = e.item_id GROUP BY suite",
    "p7_classes": f"WITH f AS (SELECT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) SELECT doc_id, min(doc_id) OVER w AS class_id, n AS variants, CAST(count(*) OVER w AS BIGINT) AS class_size FROM f JOIN (SELECT form, count(DISTINCT text) AS n FROM f GROUP BY form) USING (form) WINDOW w AS (PARTITION BY form)",
    "p7_found": f"WITH f AS (SELECT doc_id, text, {form_sql('text')} AS form FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
}
