"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from fundamentals_spark.llm.privacy import BASE, THRESHOLD
from fundamentals_spark.llm.quality import RULES, STOP_WORDS

_METRIC = {
    "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    "stop_word_ratio": "n_stop / nullif(n_words, 0)", "long_word_ratio": "n_long / nullif(n_words, 0)", "echo_ratio": "n_echo / nullif(n_words, 0)",
}


def _rules() -> str:
    out = []
    for r in RULES:
        m = f"({_METRIC[r.metric]})"
        out += [f"coalesce({m} >= {r.low}, true)"] if r.low is not None else []
        out += [f"coalesce({m} <= {r.high}, true)"] if r.high is not None else []
    return " AND ".join(out)


QUALITY = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(ws[i : i + 7], ' ')) AS c FROM g),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM h WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop, len(list_filter(ws, lambda x: length(x) > 30)) AS n_long,
  len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS n_echo FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM f"""

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) WHEN substr(reverse({_DIGITS}), i, 1) > '4' THEN 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) END)) % 10 = 0"
_IBAN = "replace(m, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"
#: kind, pattern, test of the match m (p is the text before it)
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INTEGER), 999) > 255)) = 0"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", f"length({_IBAN}) BETWEEN 15 AND 34 AND {_MOD97}"),
    ("ssn", r"[0-9-]+", f"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000' AND (0.3 + CASE WHEN regexp_matches(lower(right(p, 48)), 'ssn|social security') THEN 0.2 ELSE 0 END) >= {THRESHOLD}"),
)


def _kind(n: int, kind: str, pattern: str, valid: str) -> str:
    return rf"""a{n} AS (SELECT k, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')),
b{n} AS (SELECT k, unnest(ms) AS m, unnest(ps[1 : len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM a{n}),
c{n} AS (SELECT k, m, p, sum(length(p)) OVER o + sum(length(m)) OVER o - length(m) AS s FROM b{n} WINDOW o AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)),
s{n} AS (SELECT k, '{kind}' AS kind, {n} AS ord, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM c{n} WHERE {valid})"""


def _pii() -> str:
    base = ", ".join(f"'{k}'" for k in BASE)
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
    parts = ",\n".join(_kind(n, *k) for n, k in enumerate(_KINDS))
    union = " UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(len(_KINDS)))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
{parts},
u AS ({union}), g AS (SELECT k, {counts}, count(*) AS n, {text} FILTER (kind IN ({base})) AS b, {text} AS spans FROM u GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans FROM d LEFT JOIN g USING (k)"""


PII = _pii()

REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), e AS (SELECT *, CAST(length(h) / 2 AS BIGINT) AS n FROM d),
c AS (SELECT doc_id, h, unnest(range(0, n - 99, 500)) AS c FROM e WHERE n >= 100), q AS (SELECT doc_id, c, substr(h, 2 * c + 1, 1198) AS piece FROM c),
w AS (SELECT doc_id, c, piece, unnest(range(0, CAST(length(piece) / 2 AS BIGINT) - 99)) AS j FROM q),
g AS (SELECT doc_id, c + j AS s, row_number() OVER (PARTITION BY md5_number(substr(piece, 2 * j + 1, 200)) ORDER BY doc_id, c + j) AS k FROM w),
r AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM g WHERE k > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
j AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM j),
k AS (SELECT p.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM p JOIN e USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN k.kept IS NULL THEN h ELSE k.kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM e LEFT JOIN k USING (doc_id)"""

JACCARD = r"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT k, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
z AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE 10 * p.n >= 8 * (x.n + y.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT k, k AS t FROM d UNION SELECT r.k, e.b FROM r JOIN e ON r.t = e.a),
c AS (SELECT r.k, min(d.doc_id) AS class_id FROM r JOIN d ON d.k = r.t GROUP BY 1)
SELECT d.doc_id, c.class_id, (SELECT count(*) FROM e WHERE e.a = d.k) AS n_links FROM d JOIN c USING (k)"""

_BYTES = "flatten(list_transform(string_split(id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
_CRC = f"xor(4294967295, list_reduce({_BYTES}, lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]), CAST(4294967295 AS BIGINT)))"
SPELLING = f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS crc),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
u AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM d GROUP BY 1, 2),
h AS (SELECT r, n, {_CRC} AS h FROM u, t WHERE length(r) >= 5),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM k a JOIN k b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.p || k.s = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.p || k.s = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS best, max(m) AS m FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
z AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(z.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN z ON z.word = f.word"""

PHRASES = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS k, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
x AS (SELECT lang, ws[i : i + m - 1] AS w FROM g, (VALUES (1), (2), (3)) s(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, w, count(*) AS a FROM x GROUP BY 1, 2 HAVING count(*) >= 10), t AS (SELECT lang, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, c.a, k, l.a AS l, r.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS score FROM c JOIN f l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS o FROM s),
h AS (SELECT lang, w, max(a) AS held FROM (SELECT lang, a, unnest([w[1:2], w[2:3]]) AS w FROM f WHERE len(w) = 3) GROUP BY 1, 2),
o AS (SELECT m.lang, array_to_string(m.w, ' ') AS phrase, m.a, m.l, m.r, m.score FROM m LEFT JOIN h ON h.lang = m.lang AND h.w = m.w WHERE o = 1 AND coalesce(100 * held < 50 * m.a, true)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q JOIN t USING (lang) WHERE rank <= 2000"""
