"""DuckDB SQL of the ``opN_`` queries over whole tables. Independent of the operators' code; texts and words, never hashes of
them, are compared."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK}'), lambda x: x <> '')"


#: Links of all documents that share a shingle, and the least document that each reaches.
NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_split(_LOWER)} AS w FROM documents),
sh AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT links.b, walk.c FROM walk JOIN links ON links.a = walk.doc_id AND walk.c < links.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT doc_id, min(c) AS component_id FROM walk GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_LONG = f"(SELECT *, {_split('t')} AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"

#: Counts of the rules, and the mean log ratio of hashed byte 4-grams over all documents.
QUALITY_RULES = rf"""
WITH d AS MATERIALIZED {_LONG},
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again CROSS JOIN range(8) r(o) GROUP BY doc_id),
size AS (SELECT coalesce(sum(octet_length(encode(t))), 0) AS b FROM d),
bits AS (SELECT greatest(16, CASE WHEN b = 0 THEN 0 ELSE floor(log2(floor(256 * power(b, 1.0 / 3)))) + 1 END)::INTEGER AS bits FROM size),
grams AS MATERIALIZED (SELECT doc_id, ((('0x' || substr(h, 2 * j + 1, 8))::UBIGINT * 2654435761::UBIGINT) % 4294967296::UBIGINT) >> (32 - bits) AS g
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 3)) AS j FROM (SELECT doc_id, hex(encode(t)) AS h FROM d) WHERE len(h) >= 8), bits),
raw AS (SELECT g, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM grams GROUP BY g),
total AS (SELECT sum(raw)::DOUBLE + power(2, any_value(bits)) AS n, sum(good)::DOUBLE AS m FROM raw, bits),
odds AS (SELECT g, CASE WHEN m = 0 THEN 0 ELSE ln((good + 0.02::DOUBLE * m * prior) / (m + 0.02::DOUBLE * m)) - ln(prior) END AS odds FROM (SELECT *, (raw + 1)::DOUBLE / n AS prior FROM raw, total)),
ratio AS (SELECT doc_id, avg(odds) AS llr FROM grams JOIN odds USING (g) GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (SELECT len(x) - len(list_distinct(x)) FROM (SELECT list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS x))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS llr FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN ratio USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(llr, 6) AS llr, failed AS base_failed, NOT failed AND llr >= -0.4 AS kept FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM base)
"""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAME = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_LABEL = "(?:[A-Z]{2,10} )?PRIVATE KEY(?: BLOCK)?-----"
_KINDS = (
    ("assign", rf"""(?:{_NAME})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(v) >= 8"),
    ("access", "AKIA([A-Z0-9]+)", "length(m) >= 16"),
    ("hex", "([0-9a-f]+)", "length(m) >= 32"),
    ("pem", rf"-----BEGIN {_LABEL}(?:(?:[^-]|-{{1,4}}[^-])*-----END {_LABEL}|\s*(?:(?:Proc-Type|DEK-Info):[^\n]*\n)*[^-]*)()", "true"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}()", "true"),
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})()", "true"),
)


def _spans(n: int, kind: str, rule: str, keep: str) -> str:
    """Matches with what lies before each, whose lengths add up to the places."""
    whole = f"'(?s)(.*?)({rule})'"
    found = f"SELECT doc_id, regexp_extract_all(t, {whole}, 1) AS gs, regexp_extract_all(t, {whole}, 2) AS ms, regexp_extract_all(t, {whole}, 3) AS vs FROM d"
    each = f"SELECT doc_id, generate_subscripts(ms, 1) AS i, unnest(gs) AS g, unnest(ms) AS m, unnest(vs) AS v FROM ({found}) WHERE len(ms) > 0"
    placed = f"SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({each})"
    return f"SELECT doc_id, {n} AS k, '{kind}' AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM ({placed}) WHERE {keep}"


SECRET_SCANS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED ({" UNION ALL ".join(_spans(n, *k) for n, k in enumerate(_KINDS))}),
found AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""

_GRAMS = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))"

#: The best window of each document and item of five words or more that share a shingle, and shorter items as a whole.
DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_split("lower(coalesce(text, ''))")} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT item_id, w, array_to_string(w, ' ') AS words FROM (SELECT item_id, {_split("lower(coalesce(text, ''))")} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
dg AS MATERIALIZED (SELECT doc_id, generate_subscripts(g, 1) - 1 AS pos, unnest(g) AS s FROM (SELECT doc_id, {_GRAMS} AS g FROM d WHERE len(w) >= 5)),
bg AS MATERIALIZED (SELECT item_id, words, unnest({_GRAMS}) AS s FROM b WHERE len(w) >= 5),
weight AS MATERIALIZED (SELECT s, 1.0::DOUBLE / count(DISTINCT words) AS wt FROM bg GROUP BY s),
ic AS MATERIALIZED (SELECT item_id, s, count(*) AS ic, any_value(wt) AS wt FROM bg JOIN weight USING (s) GROUP BY item_id, s),
iw AS (SELECT item_id, sum(ic * wt) AS item_w, sum(ic)::BIGINT AS item_n FROM ic GROUP BY item_id),
pair AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ic USING (s)),
win AS MATERIALIZED (SELECT doc_id, item_id, item_w, item_n, unnest(range(0, greatest(0, len(w) - 4 - item_n) + 1)) AS start FROM pair JOIN d USING (doc_id) JOIN iw USING (item_id)),
hit AS MATERIALIZED (SELECT doc_id, item_id, pos, s, ic, wt FROM dg JOIN ic USING (s)),
enough AS MATERIALIZED (SELECT win.* FROM win JOIN hit h ON h.doc_id = win.doc_id AND h.item_id = win.item_id AND h.pos >= win.start AND h.pos < win.start + win.item_n GROUP BY ALL HAVING count(*) >= 0.79 * any_value(item_n) OR sum(h.wt) >= 0.79 * any_value(item_w)),
inside AS (SELECT e.doc_id, e.item_id, e.start, e.item_w, e.item_n, g.s, count(*) AS c FROM enough e JOIN dg g ON g.doc_id = e.doc_id AND g.pos >= e.start AND g.pos < e.start + e.item_n GROUP BY ALL),
sums AS (SELECT i.doc_id, i.item_id, i.start, any_value(i.item_w) AS item_w, any_value(i.item_n) AS item_n, sum(c * coalesce(w.wt, 1)) AS dw, sum(c) AS dn, sum(least(c, coalesce(ic, 0)) * coalesce(w.wt, 1)) AS cw, sum(least(c, coalesce(ic, 0))) AS cn
  FROM inside i LEFT JOIN weight w ON w.s = i.s LEFT JOIN ic ON ic.item_id = i.item_id AND ic.s = i.s GROUP BY 1, 2, 3),
scored AS (SELECT doc_id, item_id, start, item_n, round(greatest(cw / (dw + item_w - cw), cn::DOUBLE / (dn + item_n - cn)), 9) AS similarity FROM sums),
long AS (SELECT doc_id, item_id, start, (item_n + 4) AS n, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8 - 1e-9) WHERE r = 1),
short AS (SELECT doc_id, item_id, min(p) - 1 AS start, len(any_value(b.w)) AS n, 1.0::DOUBLE AS similarity FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) x JOIN b ON len(b.w) < 5 AND x.w[p : p + len(b.w) - 1] = b.w GROUP BY doc_id, item_id)
SELECT doc_id, item_id, start::INTEGER AS start_word, n::INTEGER AS n_words, similarity FROM (SELECT * FROM long UNION ALL SELECT * FROM short)
"""

ORACLE_SQL = {
    "op2_decontamination": DECONTAMINATION,
    "op3_minhash_dedup": NEAR_DUPLICATES,
    "op7_quality_rules": QUALITY_RULES,
    "op9_secret_scans": SECRET_SCANS,
}
