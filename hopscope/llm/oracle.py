"""SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM documents),
c AS (SELECT *, h % CAST((SELECT greatest(1, ceil(count(*) / 20000.0)) FROM documents) AS BIGINT) AS chunk FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    CAST(source_size AS DOUBLE) * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, cap <= weight * ((total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS stopped FROM w),
t AS (SELECT source, source_size, CASE WHEN stopped THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0))
    / sum(CASE WHEN NOT stopped THEN weight END) OVER ()) END AS target FROM l),
r AS (SELECT c.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY c.source ORDER BY chunk, size, h, doc_id) AS k,
    floor(CAST(('0x' || substr(md5('7|' || coalesce(c.source, chr(0))), 1, 8)) AS BIGINT) / 65536.0::DOUBLE) / 65536.0::DOUBLE AS u
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(u + e * k) - floor(u + e * (k - 1)), ceil(e)) AS BIGINT) * size AS taken FROM r
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
lines AS (SELECT doc_id, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
g AS (SELECT doc_id, p, list_value(word, lead(word, 1) OVER x, lead(word, 2) OVER x, lead(word, 3) OVER x, lead(word, 4) OVER x) AS gram,
    lead(p, 4) OVER x IS NOT NULL AS whole FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE whole) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM f) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
sc AS (SELECT *, least(1000, (10 * word_chars) // n_words) AS long_words, 1000 - least(1000, (10 * word_chars) // n_words) AS short_words,
    least(1000, (100 * n_symbols) // n_words) AS symbols, (100 * n_dup_lines) // n_lines AS dup_lines, (100 * n_repeat_words) // n_words AS repeat_words FROM b),
held AS (SELECT sc.* FROM sc JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
long AS (UNPIVOT (SELECT lang, CAST(long_words AS BIGINT) AS long_words, CAST(short_words AS BIGINT) AS short_words, CAST(symbols AS BIGINT) AS symbols,
    CAST(dup_lines AS BIGINT) AS dup_lines, CAST(repeat_words AS BIGINT) AS repeat_words FROM held)
  ON long_words, short_words, symbols, dup_lines, repeat_words INTO NAME rule VALUE score),
cnt AS (SELECT lang, rule, score, count(*) AS n_at FROM long GROUP BY ALL),
cum AS (SELECT *, coalesce(sum(n_at) OVER (PARTITION BY lang, rule ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM cnt),
st AS (SELECT lang, count(*) AS n, count(*) OVER () AS strata FROM held GROUP BY lang),
tail AS (SELECT lang, strata, i, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.002) + (n - i) * ln(0.998))) OVER (PARTITION BY lang ORDER BY i) AS cdf
  FROM (SELECT *, unnest(range(0, CAST(floor(n * 0.002) AS BIGINT) + 1)) AS i FROM st)),
allow AS (SELECT lang, max(i) AS allowed FROM tail WHERE cdf <= 0.05 / (strata * 5) GROUP BY lang),
cut AS (SELECT cum.lang, rule, min(score) AS t FROM cum JOIN allow ON cum.lang IS NOT DISTINCT FROM allow.lang WHERE above <= allowed GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(
    long_words > (SELECT t FROM cut WHERE rule = 'long_words' AND cut.lang IS NOT DISTINCT FROM sc.lang), false) AND NOT coalesce(
    short_words > (SELECT t FROM cut WHERE rule = 'short_words' AND cut.lang IS NOT DISTINCT FROM sc.lang), false) AND NOT coalesce(
    symbols > (SELECT t FROM cut WHERE rule = 'symbols' AND cut.lang IS NOT DISTINCT FROM sc.lang), false) AND NOT coalesce(
    dup_lines > (SELECT t FROM cut WHERE rule = 'dup_lines' AND cut.lang IS NOT DISTINCT FROM sc.lang), false) AND NOT coalesce(
    repeat_words > (SELECT t FROM cut WHERE rule = 'repeat_words' AND cut.lang IS NOT DISTINCT FROM sc.lang), false) AS kept
FROM sc
"""


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM p),
f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT)
    + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h JOIN f USING (hex)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEST_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP6 = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TEST_WORD}') AS w FROM benchmark),
ph AS (SELECT DISTINCT item, least(len(w), 10) AS l, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS phrase FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TEST_WORD}') AS w FROM documents),
g AS (SELECT doc_id, ls.l, unnest(range(1, len(w) - ls.l + 2)) AS p, unnest(list_transform(range(1, len(w) - ls.l + 2), lambda i: array_to_string(w[i:i + ls.l - 1], ' '))) AS phrase
  FROM d, (SELECT DISTINCT l FROM ph) ls WHERE len(w) >= ls.l),
o AS (SELECT g.doc_id, g.p, g.l, ph.item FROM g JOIN ph ON ph.l = g.l AND ph.phrase = g.phrase),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""


def _template_tree(levels: int = 5, min_rows: int = 5, z: float = 3.0, smoothing: float = 10.0) -> str:
    """The levels of the tree: r has the open rows with their template's counts and purity, e what ended at a level."""
    steps = []
    for k in range(1, levels + 1):
        steps.append(f"""m{k} AS (SELECT *, coalesce(classes[{k}], '') AS seg FROM r{k - 1} WHERE len(classes) >= {k - 1} AND tl >= {min_rows} AND tb > 0 AND tb < tl),
e{k} AS (SELECT host, classes, purity FROM r{k - 1} WHERE NOT (len(classes) >= {k - 1} AND tl >= {min_rows} AND tb > 0 AND tb < tl)),
c{k} AS (SELECT host, up, seg, sum(n) AS cn, sum(l) AS cl, sum(b) AS cb, any_value(purity) AS above, CASE WHEN sum(n) >= {min_rows} AND sum(l) > 0 THEN CAST(round(CAST(sum(b) AS DOUBLE) * 100 / sum(l)) AS BIGINT) END AS bin FROM m{k} GROUP BY ALL),
b{k} AS (SELECT host, up, bin, CAST(sum(cl) AS DOUBLE) AS l, CAST(sum(cb) AS DOUBLE) AS b, row_number() OVER (PARTITION BY host, up ORDER BY bin) AS i FROM c{k} WHERE bin IS NOT NULL GROUP BY host, up, bin),
f{k} AS (SELECT host, up, bin, i, l, b, 0 AS g FROM b{k} WHERE i = 1 UNION ALL
  SELECT host, up, bin, i, CASE WHEN fresh THEN xl ELSE l + xl END, CASE WHEN fresh THEN xb ELSE b + xb END, CASE WHEN fresh THEN g + 1 ELSE g END FROM (
    SELECT x.host, x.up, x.bin, x.i, f.l, f.b, f.g, x.l AS xl, x.b AS xb,
      abs(f.b / f.l - x.b / x.l) > {z} * sqrt((f.b + x.b) / (f.l + x.l) * (1 - (f.b + x.b) / (f.l + x.l)) * (1 / f.l + 1 / x.l)) AS fresh
    FROM f{k} f JOIN b{k} x ON x.host = f.host AND x.up = f.up AND x.i = f.i + 1)),
g{k} AS (SELECT c.*, f.g FROM c{k} c LEFT JOIN f{k} f USING (host, up, bin)),
t{k} AS (SELECT host, up, g, sum(cl) AS tl, sum(cb) AS tb, count(*) AS k, (sum(cb) + {smoothing} * any_value(above)) / (sum(cl) + {smoothing}) AS purity FROM g{k} GROUP BY host, up, g),
r{k} AS (SELECT m.host, m.classes, m.n, m.l, m.b, t.tl, t.tb, t.purity, m.up || '/' || CASE WHEN t.g IS NULL THEN '*' WHEN t.k = 1 THEN m.seg ELSE '*' || (t.g + 1) END AS up
  FROM m{k} m JOIN g{k} g USING (host, up, seg) JOIN t{k} t ON t.host = g.host AND t.up = g.up AND t.g IS NOT DISTINCT FROM g.g)""")
    return ",\n".join(steps)


_BARE, _ENDING = r"regexp_replace(x, '\.[A-Za-z]{1,5}$', '')", r"regexp_extract(x, '(\.[A-Za-z]{1,5})$', 1)"
_CLASS = (
    rf"CASE WHEN regexp_matches({_BARE}, '^[0-9]+([-_.][0-9]+)*$') THEN '{{n}}' || {_ENDING} WHEN regexp_matches({_BARE}, '^[0-9a-fA-F-]{{8,}}$') AND regexp_matches({_BARE}, '[0-9]') THEN '{{h}}' || {_ENDING} "
    rf"WHEN regexp_matches({_BARE}, '^[^-_]+([-_][^-_]+){{2,}}$') THEN '{{s}}' || {_ENDING} ELSE x END"
)


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


_RULES = (("block", "example.org/es/"), ("block", "example.org/en/1"), ("block", "com/de/"), ("allow", "com/fr/"), ("allow", "org/"))
OP10 = rf"""
WITH RECURSIVE u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r}'" for _, r in sorted(_RULES, key=lambda x: -len(x[1])))} END AS rule,
  list_transform(list_filter(str_split(path, '/'), lambda x: x <> ''), lambda x: {_CLASS}) AS classes FROM p),
w AS (SELECT *, CASE {" ".join(f"WHEN rule = '{r}' THEN '{w}'" for w, r in _RULES)} END AS given FROM v),
n AS (SELECT host, classes, count(*) AS n, count(given) AS l, count(*) FILTER (given = 'block') AS b FROM w GROUP BY host, classes),
r0 AS (SELECT host, classes, n, l, b, sum(l) OVER h AS tl, sum(b) OVER h AS tb,
    (sum(b) OVER h + 10.0::DOUBLE * (SELECT coalesce(CAST(sum(b) AS DOUBLE) / nullif(sum(l), 0), 0) FROM n)) / (sum(l) OVER h + 10.0::DOUBLE) AS purity, '' AS up FROM n WINDOW h AS (PARTITION BY host)),
{_template_tree()},
x AS ({" UNION ALL ".join(f"SELECT host, classes, purity FROM e{k}" for k in range(1, 6))} UNION ALL SELECT host, classes, purity FROM r5)
SELECT page_id, w.host, w.path, w.rule, coalesce(given, CASE WHEN x.purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM w JOIN x ON x.host = w.host AND x.classes = w.classes
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op3_warc_zip": OP3, "op5_quality_rules": OP5, "op6_fm_index": OP6, "op10_url_filters": OP10}
