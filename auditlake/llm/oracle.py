"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# A checksum step for one byte b: eight shifts of (crc XOR b), each with the polynomial where a one falls out.
_STEP = "xor(c, b)"
for _ in range(8):
    _STEP = f"list_transform([{_STEP}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"



def _checksum(text: str) -> str:
    """crc32 of a text, from its bytes."""
    code = f"list_transform(range(0, len(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), lambda c, b: {_STEP}), 4294967295)"


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP11 = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), names AS (
  SELECT name, {_checksum('name')} % 20 AS fault FROM (SELECT DISTINCT name FROM given)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given JOIN names USING (name) WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), rows AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    CASE WHEN trim(text, {_SPACES}) = '' THEN 'blank'
      WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 'duplicate'
      WHEN right(rtrim(text, {_SPACES}), 1) IN ('.', '!', '?') THEN 'sound' ELSE 'truncated' END AS kind
  FROM placed
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
), inserts(q, q1, letters, price, lines) AS (
  VALUES ('', '', '', 0, []::VARCHAR[]), ('s', 's', '', 0, []), ('u', 'u', '', 0, []), ('a', 'a', '', 0, []),
    ('', 'u', 'I', 2, ['user:']), ('s', 'u', 'I', 2, ['user:']), ('a', 'u', 'I', 2, ['user:']), ('u', 'a', 'I', 2, ['assistant:']),
    ('', 'a', 'II', 4, ['user:', 'assistant:']), ('s', 'a', 'II', 4, ['user:', 'assistant:'])
), edits AS (
  SELECT conv_id, i, q1, 'D' AS letter, 3 AS price, q1 AS q2, []::VARCHAR[] AS line FROM rows, (SELECT DISTINCT q1 FROM inserts)
  UNION ALL
  SELECT conv_id, i, q1, 'K', (kind = 'truncated')::INT, CASE WHEN initial = '' THEN q1 ELSE initial END, [role || ':' || text]
  FROM rows, (SELECT DISTINCT q1 FROM inserts)
  WHERE kind IN ('sound', 'truncated') AND (initial = '' OR q1 || '>' || initial IN ('>s', '>u', 's>u', 'u>a', 'a>u'))
  UNION ALL
  SELECT conv_id, i, q1, 'R', 2 + (kind = 'truncated')::INT, CASE WHEN q1 = 'u' THEN 'a' ELSE 'u' END,
    [CASE WHEN q1 = 'u' THEN 'assistant:' ELSE 'user:' END || text]
  FROM rows, (SELECT DISTINCT q1 FROM inserts) WHERE kind IN ('sound', 'truncated')
), steps AS (
  SELECT conv_id, i, q, q2, letters || letter AS audit, inserts.price + edits.price AS cost, lines || line AS body
  FROM edits JOIN inserts USING (q1)
), states AS (
  SELECT conv_id, 0::BIGINT AS i, '' AS q, {{'cost': 0, 'audit': '', 'body': []::VARCHAR[]}} AS best FROM counted
  UNION ALL
  SELECT s.conv_id, any_value(t.i), t.q2,
    min({{'cost': s.best.cost + t.cost, 'audit': s.best.audit || t.audit, 'body': s.best.body || t.body}})
  FROM states s JOIN steps t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = s.i + 1 AND t.q = s.q
  GROUP BY s.conv_id, t.q2
), ended AS (
  SELECT s.conv_id, min({{'cost': best.cost + price, 'audit': best.audit || letters, 'body': best.body || lines}}) AS best
  FROM states s JOIN counted c ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n
    JOIN inserts USING (q) WHERE q1 IN ('', 'a') GROUP BY s.conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.body, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted c ON ids.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON ids.conv_id IS NOT DISTINCT FROM e.conv_id
"""

OP12 = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row_no, true AS own,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT NULL, 0, false,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')
  FROM benchmark
), features AS (
  SELECT row_no, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM texts
), names AS (
  SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)
), codes AS (
  SELECT feature, list_concat([4294967295::BIGINT],
    list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS bytes
  FROM names
), hashed AS (
  SELECT feature, xor(list_reduce(bytes, lambda c, b: {_STEP}), 4294967295) % 10000 AS bucket FROM codes
), counted AS (
  SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t
  FROM features JOIN hashed USING (feature) GROUP BY bucket
), totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counted),
gains AS (
  SELECT bucket,
    floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain
  FROM counted, totals
), sums AS (
  SELECT row_no, count(*) AS n, sum(gain)::BIGINT AS total
  FROM features JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE own GROUP BY row_no
), weighed AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN sums USING (row_no) WHERE own
), scored AS (
  SELECT doc_id, n_words, n_features, weight,
    (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place::BIGINT END AS rank
FROM ranked
"""

OP13 = """
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS h,
    strlen(coalesce(text, ''))::BIGINT AS n_bytes
  FROM documents
), pieces AS (
  SELECT row_no, 1000 * p AS at_byte, substr(h, 2000 * p + 1, 2 * 1199) AS part, least(1000, n_bytes - 199 - 1000 * p) AS many
  FROM (SELECT row_no, h, n_bytes, unnest(range(0, (n_bytes - 199 + 999) // 1000)) AS p FROM texts WHERE n_bytes >= 200)
), windows AS (
  SELECT row_no, at_byte + j AS i, md5_number(substr(part, 2 * j + 1, 400)) AS code
  FROM (SELECT row_no, at_byte, part, unnest(range(0, many)) AS j FROM pieces)
), repeated AS (
  SELECT row_no, i FROM windows JOIN (SELECT code FROM windows GROUP BY code HAVING count(*) > 1) USING (code)
), marked AS (
  SELECT row_no, i, coalesce(i - lag(i) OVER (PARTITION BY row_no ORDER BY i) > 200, true) AS new FROM repeated
), numbered AS (
  SELECT row_no, i, sum(new::INT) OVER (PARTITION BY row_no ORDER BY i) AS span FROM marked
), spans AS (
  SELECT row_no, span, min(i) AS low, max(i) + 200 AS high FROM numbered GROUP BY row_no, span
), removed AS (
  SELECT row_no, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans,
    list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs
  FROM spans GROUP BY row_no
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN lows IS NULL THEN h ELSE
    array_to_string(list_transform(range(0, len(lows) + 1), lambda k:
      substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE highs[k] END) + 1,
        2 * ((CASE WHEN k = len(lows) THEN n_bytes ELSE lows[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE highs[k] END)))), '') END)) AS kept_sha256
FROM texts LEFT JOIN removed USING (row_no)
"""
