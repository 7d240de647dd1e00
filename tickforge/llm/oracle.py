"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

OP5 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (k.doc_id > f.first)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (f.first IS NULL OR k.doc_id <= f.first), '')) AS kept_sha256
FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
GROUP BY k.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, sum(step) AS r FROM (
          SELECT doc_id, least(5, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 5)) AS step FROM dup)
        GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM (
          SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(lin.n - lin.u, 0)::BIGINT AS n_dup_lines,
             coalesce(cov.r, 0)::BIGINT AS n_repeat_words, coalesce(lin.n, 0)::BIGINT AS n_lines
      FROM d LEFT JOIN lin USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
                 + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
                 + CASE WHEN word_chars < 3 * n_words THEN 8 ELSE 0 END
                 + CASE WHEN word_chars > 10 * n_words THEN 16 ELSE 0 END
                 + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits
FROM b
"""

OP7 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
           FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id
          WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM n
          UNION SELECT e.y, r.c FROM reach r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

#: Base32 of a SHA-1: every 5 hex digits (20 bits) are 4 base32 digits.
OP8 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (
  SELECT *, list_transform(range(0, 8), lambda k: ('0x' || h[5 * k + 1:5 * k + 5])::BIGINT) AS parts FROM p),
named AS (
  SELECT page_id, payload, array_to_string(list_transform(parts, lambda v:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v // 32768) % 32 + 1]
           || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v // 1024) % 32 + 1]
           || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v // 32) % 32 + 1]
           || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v % 32 + 1]), '') AS payload_digest
  FROM digits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

#: CRC-32 byte by byte: a table of 256 remainders, then one step per byte of the text.
_CRC = r"""
tab AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8),
          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab)"""


def _crc32(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


OP11 = rf"""
WITH {_CRC.strip()},
d AS (SELECT doc_id, lang, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
             {_crc32("coalesce(text, '')")}::BIGINT AS text_crc32 FROM documents, tab),
t AS (SELECT count(*) AS total FROM d),
bl AS (SELECT lang AS v, (sum(count(*)) OVER (ORDER BY lang NULLS FIRST) - count(*)) * 16 // any_value(total) AS b
       FROM d, t GROUP BY lang),
bs AS (SELECT source AS v, (sum(count(*)) OVER (ORDER BY source NULLS FIRST) - count(*)) * 16 // any_value(total) AS b
       FROM d, t GROUP BY source),
bz AS (SELECT size AS v, (sum(count(*)) OVER (ORDER BY size) - count(*)) * 16 // any_value(total) AS b
       FROM d, t GROUP BY size),
x AS (SELECT d.*, list_reduce([3, 2, 1], lambda s, b: list_reduce([1, 2, 3], lambda a, i: list_transform([1, 2, 3],
             lambda j: xor(a[j], CASE
               WHEN a[i] & (1 << b) <> 0 THEN CASE WHEN j = 1 THEN (1 << b) - 1 ELSE 0 END
               WHEN j = 1 OR j = i THEN CASE WHEN i = 1 THEN 0 ELSE xor(a[1], a[i]) & ((1 << b) - 1) END
               ELSE 0 END)), s), [bl.b::BIGINT, bs.b::BIGINT, bz.b::BIGINT]) AS a
      FROM d JOIN bl ON d.lang IS NOT DISTINCT FROM bl.v JOIN bs ON d.source IS NOT DISTINCT FROM bs.v
      JOIN bz ON d.size = bz.v),
g AS (SELECT *, [a[1], xor(a[1], a[2]), xor(xor(a[1], a[2]), a[3])] AS g,
             list_reduce([1, 2, 3], lambda t, b: CASE WHEN xor(xor(a[1], a[2]), a[3]) & (1 << b) <> 0
                                                      THEN xor(t, (1 << b) - 1) ELSE t END, 0) AS f FROM x),
h AS (SELECT doc_id, size, text_crc32, list_reduce([3, 2, 1, 0], lambda h, b: list_reduce([1, 2, 3],
             lambda v, i: v * 2 + (xor(g[i], f) >> b & 1), h), 0::BIGINT) AS curve FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos FROM h),
s AS (SELECT *, (pos * 8 // total)::INT AS shard FROM o, t)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard, curve
FROM s
"""

#: Two words are near if one is the other without a code point, or if they share
#: what is left when the code point at one place goes.
OP12 = rf"""
WITH RECURSIVE {_CRC.strip()},
runs AS (SELECT doc_id, run, count(*) AS c FROM (
           SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[a-z' || chr(192) || '-' || chr(255) || ']+')) AS run FROM documents)
         GROUP BY doc_id, run),
hashed AS (SELECT run, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, tab),
v AS (SELECT word, sum(c)::BIGINT AS n FROM (
        SELECT c, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                       ELSE run END AS word FROM hashed)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cuts AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
         FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT c.word, v.word FROM cuts c JOIN v ON c.rest = v.word
          UNION SELECT v.word, c.word FROM cuts c JOIN v ON c.rest = v.word),
near AS (SELECT p.word, count(*) AS n_near, min(ROW(-v.n, p.other)) AS best
         FROM pairs p JOIN v ON v.word = p.other GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near,
             CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form,
             CASE WHEN -best[1] >= 2 * v.n THEN (-best[1])::BIGINT END AS form_n
      FROM v LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root FROM f
         UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN f ON f.word = w.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""


def _then(path: str, cost: str, edit: str) -> str:
    """A path (nine digits of cost, then edits) and one more edit; least() of such
    strings is the cheapest, among equals the one with the least edits."""
    return f"lpad((left({path}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{edit}'"


def _if(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


_STAY, _LATE = "must = 0", "2 + late"
OP13 = rf"""
WITH RECURSIVE {_CRC.strip()},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                 CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src),
judged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS rn,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
                  regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS bare FROM rows_),
j AS (SELECT conv_id, turn, role, text, rn, left(role, 1) AS i,
             CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate'
                  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM judged),
f AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false)::INT AS must,
             coalesce(fault = 'truncated', false)::INT AS late FROM j),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, '000000000' AS k0, NULL::VARCHAR AS ks, '000000002I' AS ku, '000000004II' AS ka
  FROM conversations
  UNION ALL
  SELECT conv_id, rn, n0, ns, cu, least(na, {_then("cu", "2", "I")}) FROM (
    SELECT *, least(nu, {_then("n0", "2", "I")}, {_then("ns", "2", "I")}, {_then("na", "2", "I")}) AS cu FROM (
      SELECT dp.conv_id, f.rn, {_then("k0", "3", "D")} AS n0,
             least({_then("ks", "3", "D")}, {_if(_STAY + " AND i = 's'", _then("k0", "late", "K"))}) AS ns,
             least({_then("ku", "3", "D")}, {", ".join(
                 _if(_STAY, _then(k, _LATE, "R")) + ", " + _if(_STAY + " AND i = 'u'", _then(k, "late", "K"))
                 for k in ("k0", "ks", "ka"))}) AS nu,
             least({_then("ka", "3", "D")}, {_if(_STAY, _then("ku", _LATE, "R"))},
                   {_if(_STAY + " AND i = 'a'", _then("ku", "late", "K"))}) AS na
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.rn = dp.rn + 1))),
best AS (SELECT conv_id, least(k0, ka) AS path FROM dp QUALIFY rn = max(rn) OVER (PARTITION BY conv_id)),
audits AS (SELECT conv_id, left(path, 9)::BIGINT AS cost, substr(path, 10) AS audit FROM best),
walk AS (
  SELECT conv_id, audit, 0 AS p, 0::BIGINT AS rn, '' AS st, []::VARCHAR[] AS said FROM audits
  UNION ALL
  SELECT conv_id, audit, p + 1, nrn, coalesce(left(who, 1), st),
         CASE WHEN who IS NULL THEN said ELSE list_append(said, who || ':' || what) END FROM (
    SELECT w.*, w.rn + (e <> 'I')::INT AS nrn,
           CASE e WHEN 'D' THEN NULL WHEN 'K' THEN f.role ELSE CASE WHEN st = 'u' THEN 'assistant' ELSE 'user' END END AS who,
           CASE WHEN e = 'I' THEN '' ELSE f.text END AS what
    FROM (SELECT *, substr(audit, p + 1, 1) AS e FROM walk WHERE p < length(audit)) w
    LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.rn + 1)),
texts AS (SELECT conv_id, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
          FROM walk WHERE p = length(audit)),
pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY rn) AS pre FROM f),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                  count(*) FILTER (fault = 'blank')::BIGINT AS blank, count(*) FILTER (fault = 'duplicate')::BIGINT AS duplicate,
                  count(*) FILTER (fault = 'truncated')::BIGINT AS truncated,
                  count(*) FILTER (pre IS NOT NULL AND pre || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
           FROM pairs GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, repaired_sha256
FROM audits a JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5, "op7_ngram_jaccard": OP7, "op8_warc": OP8, "op9_quality_rules": OP9,
            "op11_hilbert_sharding": OP11, "op12_spelling_variants": OP12,
            "op13_conversation_repair": OP13}
