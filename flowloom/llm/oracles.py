"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from . import licenses, spelling, urls


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP3 = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts),
patterns(name, action, pattern, exception) AS (VALUES {", ".join(f"({_quoted(x.name)}, {_quoted(x.action)}, {_quoted(x.pattern)}, {x.exception})" for x in urls.RULES if not x.listed)}),
hits AS (
  SELECT r, arg_max(name, (exception, length(name), name)) AS name, arg_max(action, (exception, length(name), name)) AS action
  FROM parts JOIN patterns ON regexp_matches(host || path, pattern) GROUP BY r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE coalesce(action, 'allow') END AS verdict,
  name AS pattern_rule
FROM judged LEFT JOIN hits USING (r)
"""


def _canonical(expr: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({expr}), {_quoted(licenses.COPYRIGHT)}, ' ', 'g'), {_quoted(licenses.SEPARATORS)}, ' ', 'g'))"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


OP10 = f"""
WITH known AS (
  SELECT sha256({_canonical("t")}) AS digest, min(license) AS license
  FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in licenses.KNOWN + licenses.whole_texts())}) AS k(license, t) GROUP BY 1),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, 0::BIGINT AS line_no, text AS body FROM split WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', i, parts[i] FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM split WHERE len(parts) > 1))
SELECT doc_id, unit, line_no, license, digest
FROM (SELECT *, sha256({_canonical("body")}) AS digest FROM units) JOIN known USING (digest)
"""

OP7 = """
WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (
  SELECT r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM rows),
shingles AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.r AS x, b.r AS y, a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT DISTINCT a, b FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM rows UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT rows.doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(rows.doc_id = component_id, false) AS kept
FROM rows LEFT JOIN sizes USING (r) LEFT JOIN least ON rows.doc_id = least.doc_id
"""

OP4 = """
WITH digits AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 400)) AS i FROM digits WHERE len(h) >= 800)),
twice AS (SELECT s FROM starts GROUP BY 1 HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w + 400, -1) AS fresh FROM starts JOIN twice USING (s) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits) GROUP BY doc_id, r),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), len(any_value(h)) // 2 FROM runs JOIN digits USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS k FROM gaps JOIN digits USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM digits LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""



def _crc_table() -> list[int]:
    """crc32 of one byte after the register is shifted out: the reflected polynomial, eight times."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP11 = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, translate(r, '{spelling.UPPER}', '{spelling.LOWER}') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)),
runs AS (SELECT doc_id, r, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM found WHERE len(r) >= 6 GROUP BY ALL),
sums AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2),
    lambda i: (16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
    lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]::BIGINT))) AS h
  FROM runs),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN r[:h % len(r)] || r[h % len(r) + 2:] ELSE r END AS word, n FROM sums)
  WHERE len(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS d FROM (SELECT *, unnest(range(len(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON d = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON d = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM near GROUP BY 1),
named AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
ways(word, root, form) AS (
  SELECT word, word, form FROM named
  UNION ALL SELECT w.word, w.form, x.form FROM ways w JOIN named x ON x.word = w.form)
SELECT word, named.form, root, n, n_near, form_n FROM named JOIN (SELECT word, root FROM ways WHERE form IS NULL) USING (word)
"""


def _floor_div(a: str, b: str) -> str:
    return f"(({a} - (({a}) % ({b}) + ({b})) % ({b})) // ({b}))"


def _op12() -> str:
    sql = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (r))"""
    for k in range(3):
        sql += f""",
near{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, parts.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} b ON parts.p = b.p)
  GROUP BY r, p)"""
        if k < 2:
            sql += f""",
moved{k} AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, e, i, {_floor_div("sum(x[i])::BIGINT", "count(*)")} AS m
        FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN moved{k} m USING (p, e))"""
    return sql + """,
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest
"""


OP12 = _op12()

OP13 = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER o = 1 AS kept, sha256(t) AS text_sha256
FROM rows WINDOW o AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r)
"""

ORACLES = {
    "op3_url_filters": OP3,
    "op4_suffix_repeats": OP4,
    "op7_near_duplicates": OP7,
    "op10_license_scan": OP10,
    "op11_spelling_variants": OP11,
    "op12_vector_codes": OP12,
    "op13_exact_duplicates": OP13,
}
