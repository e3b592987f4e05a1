"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH docs AS (
    SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
    SELECT k, doc_id, line - 1 AS line,
        trim(lines[line], ' ') || chr(10) || trim(lines[line + 1], ' ') || chr(10) || trim(lines[line + 2], ' ') AS body
    FROM (SELECT k, doc_id, lines, unnest(range(1, len(lines) - 1)) AS line FROM docs WHERE text IS NOT NULL)
), firsts AS (
    SELECT body, min((doc_id, line)) AS first FROM windows WHERE body <> chr(10) || chr(10)
    GROUP BY body HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT k, unnest(range(line, line + 3)) AS line
    FROM windows JOIN firsts USING (body) WHERE (doc_id, line) <> first
), islands AS (
    SELECT k, min(line) AS start, max(line) + 1 AS stop
    FROM (SELECT k, line, line - row_number() OVER (PARTITION BY k ORDER BY line) AS island FROM gone)
    GROUP BY k, island
), cut AS (
    SELECT k, sum(stop - start) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed
    FROM islands GROUP BY k
), kept AS (
    SELECT k, string_agg(body, chr(10) ORDER BY line) AS text
    FROM (SELECT k, unnest(lines) AS body, unnest(range(len(lines))) AS line FROM docs) ANTI JOIN gone USING (k, line)
    GROUP BY k
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(removed, '') AS removed,
    CASE WHEN docs.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM docs LEFT JOIN cut USING (k) LEFT JOIN kept USING (k)
"""

PREFERENCE = r"""
WITH clean AS (
    SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text FROM clean
), replies AS (
    SELECT conv_id, max(k) AS k, max_by(text, k) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id
), pairs AS (
    SELECT c.conv_id, c.n, coalesce(own.k, c.n + 1) AS reply_at, own.k IS NOT NULL AS has, other.text AS other
    FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) c
    LEFT JOIN replies own USING (conv_id) LEFT JOIN replies other ON other.conv_id = xor(c.conv_id, 1)
), rejected AS (
    SELECT t.conv_id, CASE WHEN has AND other IS NULL AND t.k > reply_at THEN t.k - 1 ELSE t.k END AS k, role,
        CASE WHEN has AND t.k = reply_at THEN other ELSE t.text END AS text
    FROM turns t JOIN pairs USING (conv_id) WHERE NOT (has AND t.k = reply_at AND other IS NULL)
), same AS (
    SELECT t.conv_id, t.k, bool_and(coalesce(t.role = r.role AND t.text = r.text, false))
        OVER (PARTITION BY t.conv_id ORDER BY t.k) AS same
    FROM turns t LEFT JOIN rejected r USING (conv_id, k)
), shared AS (
    SELECT conv_id, count(*) FILTER (same) AS n_shared FROM same GROUP BY conv_id
), drawn AS (
    SELECT 'c' AS side, * FROM turns UNION ALL SELECT 'r', * FROM rejected
), texts AS (
    SELECT conv_id, n_shared,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (side = 'c' AND k <= n_shared) AS prompt,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (side = 'c' AND k > n_shared) AS chosen,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) FILTER (side = 'r' AND k > n_shared) AS rejected,
        string_agg((13 + length(role)) || ':0,' || (11 + length(text)) || ':' || (role = 'assistant')::INT, ',' ORDER BY k) FILTER (side = 'c' AND k > n_shared) AS chosen_mask,
        string_agg((13 + length(role)) || ':0,' || (11 + length(text)) || ':' || (role = 'assistant')::INT, ',' ORDER BY k) FILTER (side = 'r' AND k > n_shared) AS rejected_mask
    FROM drawn JOIN shared USING (conv_id) GROUP BY conv_id, n_shared
)
SELECT conv_id, n_shared, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
    coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM texts
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM (
        SELECT coalesce(item_id::VARCHAR, 'null') AS item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s
        FROM i WHERE len(w) > 0)
), windows AS (
    SELECT rid, s, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM (
        SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN (SELECT DISTINCT n FROM item_windows) ON len(w) >= n)
), found AS (
    SELECT rid, s, n, item FROM windows JOIN item_windows USING (n, body)
), hit AS (
    SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY rid
), names AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN names USING (rid)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS body FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (body)
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
    SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
    SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

_PATTERNS = (
    ("assign", r"""(?:((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]+)", 1, 24),
    ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 0),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 0),
)
_MATCHES = " UNION ALL ".join(
    f"""
    SELECT rid, {k} AS o, '{kind}' AS kind, {least} AS least, string_split_regex(text, '{pattern}') AS gaps,
        regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS part FROM d"""
    for k, (kind, pattern, group, least) in enumerate(_PATTERNS)
)

SECRETS = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), matches AS ({_MATCHES}
), each AS (
    SELECT rid, o, kind, least, k, length(gaps[k]) + length(whole[k]) AS step, length(whole[k]) AS size, length(part[k]) AS measured
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM matches)
), spans AS (
    SELECT rid, o, kind, stop - size AS start, stop FROM (
        SELECT *, sum(step) OVER (PARTITION BY rid, o ORDER BY k) AS stop FROM each) WHERE measured >= least
), found AS (
    SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (o < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
    FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (rid)
"""

CAPTURES = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), top AS (
    SELECT body, max(page_id) AS first FROM p GROUP BY body
)
SELECT page_id, strlen(body) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS complete
FROM p JOIN top USING (body)
"""

ORACLES: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_secret_scan": SECRETS,
    "op4_preference": PREFERENCE,
    "op6_decontamination": CONTAMINATION,
    "op7_jaccard_join": JACCARD,
    "op8_warc": CAPTURES,
}
