"""The queries of this package in SQL, over whole tables, where SQL can express them."""

from __future__ import annotations

from tidemark.llm.quality_rules import RULES, STOP_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) t(i)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
cut AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN least USING (g), range(13) r(o) WHERE doc_id > m),
each AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (
    SELECT e.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY e.p) FILTER (c.p IS NULL) AS text
    FROM each e LEFT JOIN cut c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))


def _rule(rule) -> str:
    parts = [f"({rule.measure}) >= {rule.low}"] if rule.low is not None else []
    parts += [f"({rule.measure}) <= {rule.high}"] if rule.high is not None else []
    return " AND ".join(parts)


OP3 = rf"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) t(i)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (
    SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM win JOIN twice USING (doc_id, g), range(8) r(o)
    GROUP BY doc_id),
m AS (
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(list_filter(ws, lambda x: list_contains([{_STOPS}], lower(x)))) AS n_stop_words,
           len(regexp_extract_all(body, '[!?]{{2,}}')) AS n_shouts,
           len(regexp_extract_all(body, '\p{{Lu}}')) AS n_capitals
    FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {" AND ".join(_rule(r) for r in RULES)} END AS kept
FROM b
"""

OP4 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
newest AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN newest USING (payload_digest)
"""

OP8 = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) t(i)
    UNION ALL SELECT doc_id, '# ' || array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.doc_id <> y.doc_id
    GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id
"""

OP10 = r"""
WITH t AS (
    SELECT conv_id, turn, replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]', ' ', 'g'), '<|', '< |') AS speaker,
           replace(coalesce(text, ''), '<|', '< |') AS content
    FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
    SELECT conv_id, perspective, turn, speaker, content,
           CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
           '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
                                  ELSE 'user name=' || speaker END || chr(10) AS head
    FROM t JOIN people USING (conv_id)),
s AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM r),
o AS (
    SELECT *, row_number() OVER w - 1 AS step, CAST(coalesce(sum(length(segment)) OVER
           (PARTITION BY conv_id, perspective ORDER BY turn, speaker, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS BIGINT) AS start
    FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn, speaker, content))
SELECT conv_id, perspective, step, turn, role, speaker, segment, start,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
       CASE WHEN role = 'assistant' THEN start + length(segment) END AS mask_end
FROM o
"""


def _crc32(number: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""


OP11 = rf"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {_crc32("conv_id")} % 4 AS h, conv_id - conv_id % 20 AS first_id FROM t),
r AS (
    SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN t ON t.conv_id = first_id AND pos <= h
    UNION ALL SELECT c.conv_id, 2, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM r),
p AS (
    SELECT conv_id, 0 AS d, '' AS key, 0 AS words FROM c
    UNION ALL
    SELECT conv_id, d, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d),
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM s),
linked AS (
    SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent,
           lead(key) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM p),
node AS (
    SELECT key, d, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM linked GROUP BY key, d),
kids AS (SELECT parent AS key, count(*) AS k FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (
    SELECT p.key, count(*) FILTER (k IS NULL) AS n_leaves, sum((n - 1) * node.words)::BIGINT AS saved_tokens
    FROM node LEFT JOIN kids USING (key) JOIN p ON p.conv_id = node.conv_id AND p.d <= node.d GROUP BY p.key)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children,
       n_leaves, saved_tokens, node.ends_sha256
FROM node LEFT JOIN node up ON up.key = node.parent LEFT JOIN kids ON kids.key = node.key JOIN below ON below.key = node.key
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def _climb(name: str, bottom: str) -> str:
    """Nodes ``lvl, grp, pos, n, digest`` from those of ``bottom`` up to one per group."""
    return f"""{name} AS (
    SELECT 0 AS lvl, grp, pos, n, digest FROM {bottom}
    UNION ALL
    SELECT lvl + 1, grp, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
    FROM {name} WHERE n > 1 GROUP BY lvl, grp, n, pos // 8)"""


def _steps(name: str, rows: str, nodes: str, after: int) -> str:
    """For each of ``rows`` (``own, grp, pos``) and level the digests left and right of its node."""
    return f"""{name} AS (
    SELECT own, {after} + lvl AS k,
           coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < r.pos >> (3 * lvl)), '') AS before,
           coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > r.pos >> (3 * lvl)), '') AS after
    FROM {rows} r JOIN {nodes} n ON n.grp = r.grp AND n.pos // 8 = (r.pos >> (3 * lvl)) // 8 AND n.n > 1
    GROUP BY own, lvl)"""


OP12 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce('+' || lang, '') AS grp, {_leaf("text")} AS leaf,
           CASE WHEN {_crc32("doc_id")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
                ELSE {_leaf("text")} END AS found
    FROM documents),
own_leaves AS (
    SELECT *, leaf AS digest, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS own,
           row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
    FROM d),
{_climb("nodes", "own_leaves")},
langs AS (
    SELECT grp AS lang, '' AS grp, digest, count(*) OVER () AS n, row_number() OVER (ORDER BY grp) - 1 AS pos, grp AS own
    FROM nodes WHERE n = 1),
{_climb("tops", "langs")},
{_steps("low", "own_leaves", "nodes", 0)},
{_steps("high", "langs", "tops", 0)},
steps AS (
    SELECT own, row_number() OVER (PARTITION BY own ORDER BY k) AS k, before, after FROM (
        SELECT own, k, before, after FROM low
        UNION ALL SELECT o.own, 100 + h.k, h.before, h.after FROM own_leaves o JOIN high h ON h.own = o.grp)),
fold AS (
    SELECT own, 0 AS k, found AS node FROM own_leaves
    UNION ALL SELECT f.own, s.k, sha256(before || node || after) FROM fold f JOIN steps s ON s.own = f.own AND s.k = f.k + 1),
proofs AS (SELECT own, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY own),
ends AS (SELECT own, arg_max(node, k) AS folded_root FROM fold GROUP BY own)
SELECT doc_id, leaf, l.digest AS subroot, t.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
       folded_root, folded_root = t.digest AS verified
FROM own_leaves o JOIN langs l ON l.lang = o.grp JOIN ends e ON e.own = o.own LEFT JOIN proofs p ON p.own = o.own
CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""

ORACLE: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op3_quality_rules": OP3,
    "op4_warc": OP4,
    "op8_jaccard_join": OP8,
    "op10_chat_formatting": OP10,
    "op11_conversation_trie": OP11,
    "op12_merkle_manifest": OP12,
}
