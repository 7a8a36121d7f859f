"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from mercata.llm.licenses import TEMPLATES

#: A-Z to a-z and nothing else.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINE_DEDUP = rf"""
WITH numbered AS (
  SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents
), lines AS (
  SELECT doc_id, rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM numbered
), keyed AS (
  SELECT *, {_LOWER.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT any_value(doc_id) AS doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f USING (key)
GROUP BY rid
"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + f", '{_WORD}')"

_DECONTAMINATE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, {_WORDS.format("text")} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p + 1 : p + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS p FROM i WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT rid, size, p, array_to_string(w[p + 1 : p + size], ' ') AS win
  FROM (SELECT rid, w, size, unnest(range(len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size)
), found AS (
  SELECT rid, size, p, item_id FROM doc_windows JOIN item_windows USING (size, win)
), hit AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS q FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS head FROM p
)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM f
"""

_CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS rid
  FROM conversations
), answers AS (
  SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS last
  FROM t WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id
), swaps AS (
  SELECT a.conv_id, a.last, b.last.text AS swap
  FROM answers a LEFT JOIN answers b ON b.conv_id = xor(a.conv_id, 1)
), other AS (
  SELECT t.conv_id, t.turn, t.role,
         coalesce(t.role = 'assistant' AND t.turn IS NOT DISTINCT FROM s.last.turn AND t.text = s.last.text, false) AS is_last,
         t.text, s.swap
  FROM t LEFT JOIN swaps s ON t.conv_id = s.conv_id
), chosen AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS a
  FROM t GROUP BY conv_id
), rejected AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS b
  FROM (SELECT conv_id, turn, role, CASE WHEN is_last THEN swap ELSE text END AS text
        FROM other WHERE NOT (is_last AND swap IS NULL))
  GROUP BY conv_id
), cut AS (
  SELECT conv_id, a, b,
         coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n
  FROM (SELECT c.conv_id, a, coalesce(b, []) AS b FROM chosen c LEFT JOIN rejected r ON c.conv_id IS NOT DISTINCT FROM r.conv_id)
), parts AS (
  SELECT conv_id, n, a[1:n] AS p, a[n + 1:] AS a, b[n + 1:] AS b FROM cut
), drawn AS (
  SELECT conv_id, n, len(a) = 0 AND len(b) = 0 AS same,
         list_transform(p, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS p,
         list_transform(a, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS ra,
         list_transform(b, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)) AS rb,
         a, b
  FROM parts
)
SELECT conv_id, n AS n_prompt, same,
       sha256(array_to_string(p, '')) AS prompt_sha256,
       sha256(array_to_string(ra, '')) AS chosen_sha256,
       sha256(array_to_string(rb, '')) AS rejected_sha256,
       array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: a[i].role = 'assistant'),
         lambda i: (coalesce(list_sum(list_transform(ra[1:i - 1], lambda x: length(x))), 0)::BIGINT + 13 + length(a[i].role)) || '-'
                || (list_sum(list_transform(ra[1:i], lambda x: length(x)))::BIGINT)), ',') AS chosen_spans,
       array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: b[i].role = 'assistant'),
         lambda i: (coalesce(list_sum(list_transform(rb[1:i - 1], lambda x: length(x))), 0)::BIGINT + 13 + length(b[i].role)) || '-'
                || (list_sum(list_transform(rb[1:i], lambda x: length(x)))::BIGINT)), ',') AS rejected_spans
FROM drawn
"""

_TOKENS = (
    "list_filter(string_split_regex("
    + _LOWER.format("coalesce({}, '')")
    + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
_NOTICES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)

_LICENSES = rf"""
WITH templates(license, text) AS (VALUES {_NOTICES}),
t AS (SELECT license, text AS template, word, count(*) AS tf FROM (SELECT license, text, unnest({_TOKENS.format("text")}) AS word FROM templates) GROUP BY ALL),
f AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         concat_ws('/', coalesce(source, ''), coalesce(lang, ''), if(doc_id // 1000 > 0, (doc_id // 1000)::VARCHAR, NULL)) AS dir
  FROM documents),
doc_words AS (SELECT DISTINCT rid, unnest({_TOKENS.format("text")}) AS word FROM f),
idf AS (
  SELECT word, ln((1 + (SELECT count(*) FROM f))::DOUBLE / (1 + count(rid))) + 1 AS idf
  FROM (SELECT rid, word FROM doc_words UNION ALL SELECT NULL, word FROM (SELECT DISTINCT word FROM t)) GROUP BY word),
vectors AS (SELECT license, template, word, tf * idf AS w FROM t JOIN idf USING (word)),
passages AS (
  SELECT rid, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT rid, string_split(text, chr(10)) AS l FROM f)
  UNION ALL SELECT rid, -1, text FROM f
  UNION ALL SELECT rid, -2 - line, text
  FROM (SELECT rid, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT rid, regexp_split_to_array(text, '\n\n+') AS l FROM f))
  WHERE contains(text, chr(10))),
counts AS (
  SELECT rid, line, word, count(*) AS tf FROM (SELECT rid, line, unnest({_TOKENS.format("text")}) AS word FROM passages) GROUP BY ALL),
weighted AS (
  SELECT rid, line, word, tf * idf AS w FROM counts JOIN idf USING (word)),
norms AS (SELECT rid, line, sum(w * w) AS norm FROM weighted GROUP BY ALL),
dots AS (
  SELECT rid, line, license, template, sum(p.w * v.w) AS dot FROM weighted p JOIN vectors v USING (word) GROUP BY ALL),
cosines AS (
  SELECT rid, line, license, round(dot / sqrt(norm * (SELECT sum(w * w) FROM vectors v WHERE v.license = dots.license AND v.template = dots.template)), 6) AS cosine
  FROM dots JOIN norms USING (rid, line)),
own AS (
  SELECT rid, license, cosine, if(line = -1, 'file', 'header') AS origin FROM cosines
  WHERE cosine >= if(line = -1, 0.5, 0.7)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY line = -1 DESC, cosine DESC, license) = 1),
marked AS (SELECT f.*, dir || '/' || doc_id AS path, license, cosine, origin FROM f LEFT JOIN own USING (rid)),
declared AS (
  SELECT dir AS directory, license, cosine FROM marked WHERE origin = 'file'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
above AS (
  SELECT dir, unnest(range(len(p) + 1)) AS up, p FROM (SELECT DISTINCT dir, string_split(dir, '/') AS p FROM marked)),
nearest AS (
  SELECT dir, directory, license, cosine
  FROM (SELECT dir, up, array_to_string(p[1:len(p) - up], '/') AS directory FROM above) JOIN declared USING (directory)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY up) = 1)
SELECT m.doc_id, m.path, coalesce(m.license, n.license) AS license,
       coalesce(m.origin, if(n.license IS NOT NULL, 'inherited', NULL)) AS origin,
       if(m.origin IS NULL, n.cosine, m.cosine) AS cosine, if(m.origin IS NULL, n.directory, NULL) AS directory
FROM marked m LEFT JOIN nearest n USING (dir)
"""

#: The unsigned crc32 of an ASCII string, by the byte table of the reversed polynomial.
_CRC_TABLE = """(SELECT list(list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) FROM range(256) AS r(n))"""
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295::BIGINT)"""


def _edit(v: str, cost: str, letter: str) -> str:
    """A state (six digits of cost, then the audit) after one more edit."""
    return f"printf('%06d', left({v}, 6)::INT + {cost}) || substr({v}, 7) || '{letter}'"


def _keep(v: str, initial: str) -> str:
    return f"CASE WHEN NOT forced AND initial = '{initial}' THEN {_edit(v, 'extra', 'K')} END"


def _rerole(v: str) -> str:
    return f"CASE WHEN NOT forced THEN {_edit(v, '3 + extra', 'R')} END"


#: States with empty turns inserted: a user after the start, a system or an assistant turn, then an assistant.
_INSERTED = """SELECT * EXCLUDE (u, a), u1 AS u, least(a, {late}) AS a
  FROM (SELECT *, least(u, {first}, {second}, {third}) AS u1 FROM {source})"""


def _inserted(source: str) -> str:
    return _INSERTED.format(
        late=_edit("u1", "3", "I"), first=_edit("z", "3", "I"), second=_edit("s", "3", "I"), third=_edit("a", "3", "I"), source=source
    )


# The cheapest edits by an automaton of the grammar: z nothing yet, s, u and a the last turn; least of (cost, audit) in each.
_REPAIR = rf"""
WITH RECURSIVE crcs AS (SELECT {_CRC_TABLE} AS crc), t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
  FROM conversations, crcs
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM t UNION ALL SELECT * FROM t WHERE fault = 3) WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), marked AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut
  FROM placed
), faults AS (
  SELECT *, blank OR again AS forced, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM marked
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
         count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE extra > 0) AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM faults GROUP BY conv_id
), aligned AS (
  SELECT conv_id, n, 0::BIGINT AS i, '000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM counts
  UNION ALL
  SELECT conv_id, n, i, {_edit("z", "4", "D")} AS z, least({_edit("s", "4", "D")}, {_keep("z", "s")}) AS s,
         least({_edit("u", "4", "D")}, {_keep("z", "u")}, {_keep("s", "u")}, {_keep("a", "u")}, {_rerole("z")}, {_rerole("s")}, {_rerole("a")}) AS u,
         least({_edit("a", "4", "D")}, {_keep("u", "a")}, {_rerole("u")}) AS a
  FROM (SELECT b.conv_id, b.n, f.i, b.z, b.s, b.u, b.a, f.forced, f.extra, f.initial
        FROM ({_inserted("aligned")}) b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1)
), best AS (
  SELECT conv_id, left(v, 6)::BIGINT AS cost, substr(v, 7) AS audit
  FROM (SELECT conv_id, least(z, a) AS v FROM ({_inserted("aligned")}) WHERE i = n)
), steps AS (
  SELECT conv_id, p, edit, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS o
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS p FROM best WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), drawn AS (
  SELECT s.conv_id, p, o, edit, f.role, f.text,
         max(CASE WHEN o = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND s.edit <> 'I'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS text
  FROM drawn WHERE edit <> 'D' GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

# Every prefix of every rebuilt conversation, grouped; each node adds to all its ancestors.
_TRIE = rf"""
WITH crcs AS (SELECT {_CRC_TABLE} AS crc), t AS (
  SELECT conv_id, turn, md5(length(role)::VARCHAR || ':' || role || text) AS key,
         len(regexp_extract_all(text, '[^ 	-
]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
), own AS (
  SELECT conv_id, list(struct_pack(key := key, words := words) ORDER BY turn NULLS FIRST, key) AS turns FROM t GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, coalesce(b.turns[1:h], []) || o.turns[h + 1:] AS turns
  FROM (SELECT *, coalesce({_CRC.format("conv_id::VARCHAR")} % 4, 0) AS h FROM own, crcs) o
  LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), prefixes AS (
  SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda x: x.key), ',') AS node,
         CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.key), ',') END AS parent,
         CASE WHEN d > 0 THEN turns[d].words ELSE 0 END AS words, len(turns) AS n,
         list_transform(range(d + 1), lambda k: array_to_string(list_transform(turns[1:k], lambda x: x.key), ',')) AS above
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS saved, any_value(above) AS above,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY node
), children AS (
  SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT top, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM (SELECT unnest(above) AS top, saved, c.n_children FROM nodes LEFT JOIN children c ON c.parent = nodes.node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN children c ON c.parent = n.node
"""

SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op2_decontaminate": _DECONTAMINATE,
    "op5_warc": _WARC,
    "op6_license_scan": _LICENSES,
    "op8_preference_pairs": _CHAT,
    "op12_repair": _REPAIR,
    "op13_prefix_trie": _TRIE,
}
