"""The derived views in SQL, for the oracle."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "feed_items": r"""
        SELECT event_id AS id, event_type || ' by user ' || user_id AS title, d.source AS original_title,
               d.text AS summary, 'src' || k AS source_name,
               'https://site.test/items/' || event_id AS link_site, 'https://origin.test/' || event_id AS link_original,
               CASE WHEN event_type <> 'error' THEN ts - k * INTERVAL 1 HOUR END AS published_at,
               ts AS discovered_at,
               CASE event_type WHEN 'click' THEN 'ai-models' WHEN 'view' THEN 'ai-products' WHEN 'purchase' THEN 'industry'
                    WHEN 'signup' THEN 'paper' ELSE 'other' END AS category,
               CASE WHEN value <= 100 THEN CAST(floor(value) AS INTEGER) END AS score,
               value >= 50 AS selected
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events) e
        LEFT JOIN documents d ON d.doc_id = e.event_id""",
    "timeline_items": r"""
        SELECT *, CASE WHEN published_at IS NULL THEN discovered_at
                       WHEN discovered_at - published_at > INTERVAL 72 HOUR THEN published_at
                       ELSE discovered_at END AS timeline_ts,
               max(discovered_at) OVER () AS now
        FROM feed_items""",
    "story_reports": "SELECT user_id * 100 + day(ts) AS story_id, event_id AS report_id, ts FROM events",
    "story_alias": """
        SELECT c_custkey AS old_id, c_custkey // 3 AS new_id FROM customer
        WHERE c_mktsegment <> 'HOUSEHOLD' AND c_custkey > 0""",
    "mirror": "SELECT c_custkey AS id, c_acctbal AS value FROM customer",
    "changes": """
        SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS op,
               user_id AS id, value FROM events""",
    "fs_entry": """
        SELECT '/' || r_name || '/' || n_name || '/c' || c_custkey || '/o' || o_orderkey || '/l' || l_linenumber
                   || '-' || l_partkey || '-' || l_suppkey AS path,
               CAST(l_quantity AS BIGINT) * 1048576 AS size_bytes, l_discount >= 0.095 AS is_symlink,
               l_quantity >= 50 AS denied
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT path, 0, false, true FROM customer_dirs WHERE c_mktsegment = 'AUTOMOBILE' AND c_acctbal < 0""",
    "readable": "SELECT path, size_bytes FROM fs_entry WHERE NOT is_symlink AND NOT denied",
    "dirs": """
        SELECT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir, path, size_bytes
        FROM (SELECT path, size_bytes, unnest(range(2, len(string_split(path, '/')))) AS n FROM readable)""",
    "customer_dirs": """
        SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, r_name, n_name,
               '/' || r_name || '/' || n_name || '/c' || c_custkey AS path
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "targets": """
        SELECT CASE r_name WHEN 'AFRICA' THEN 'home' WHEN 'AMERICA' THEN 'applications' ELSE lower(n_name) END AS "group",
               '/' || r_name || '/' || n_name AS root,
               CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 102400 ELSE 51200 END AS floor_kb
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT 'c' || c_custkey, path, 51200 FROM customer_dirs WHERE c_mktsegment = 'AUTOMOBILE'""",
    "child_sizes": """
        SELECT "group", root, split_part(substr(path, length(root) + 2), '/', 1) AS name, floor_kb,
               CAST(sum(size_bytes) AS BIGINT) // 1024 AS size_kb
        FROM targets JOIN dirs ON dir = root GROUP BY ALL""",
    "tier_prefixes": """
        SELECT '/' || r_name AS prefix,
               CASE r_name WHEN 'AFRICA' THEN 'green' WHEN 'AMERICA' THEN 'yellow' WHEN 'ASIA' THEN 'red' END AS tier
        FROM region WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')
        UNION ALL
        SELECT path, 'red' FROM customer_dirs WHERE c_mktsegment = 'MACHINERY'""",
    "tier_items": r"""
        SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'green'
                    WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'yellow' ELSE 'red' END AS tier,
               c_custkey AS name, path,
               '约 ' || CAST(floor(abs(c_acctbal)) AS BIGINT) || CASE WHEN c_nationkey < 8 THEN ' GB'
                    WHEN c_nationkey < 16 THEN ' MB（估算）' WHEN c_nationkey < 20 THEN ' TB' ELSE ' KB' END AS size_text,
               path || '/o' || c_custkey AS order_path
        FROM customer_dirs""",
    "grants": """
        SELECT mode, path FROM (
            SELECT unnest(CASE tier WHEN 'green' THEN ['rm', 'trash', 'open'] ELSE ['trash', 'open'] END) AS mode, path
            FROM (SELECT tier, unnest([order_path, path || '/tmp']) AS path FROM tier_items WHERE tier <> 'red')
            UNION
            SELECT 'open', path FROM tier_items
            WHERE tier = 'yellow' AND path IN (SELECT dir FROM all_dirs)
            UNION
            SELECT 'open', p FROM (SELECT unnest([path, order_path]) AS p FROM tier_items WHERE tier = 'red')
            WHERE p IN (SELECT dir FROM all_dirs))""",
    "all_dirs": """
        SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS dir
        FROM (SELECT path, unnest(range(2, len(string_split(path, '/')) + 1)) AS n FROM fs_entry)""",
    "link_ends": """
        SELECT c.c_custkey AS n, e.path AS dir, e.c_custkey AS end_key
        FROM customer_dirs c JOIN customer_dirs e
          ON e.c_custkey = CASE WHEN c.c_custkey = 0 THEN 0 ELSE c.c_custkey // (c.c_custkey & -c.c_custkey) END""",
    "linked_paths": """
        SELECT o_orderkey, o_custkey,
               CASE o_orderkey % 4 WHEN 0 THEN '/hop/n' || (o_custkey % 25) || '/c' || o_custkey || '/o' || o_orderkey
                    WHEN 1 THEN '/links/./c' || o_custkey || '/../c' || o_custkey || '/o' || o_orderkey
                    WHEN 2 THEN '/links/r' || o_custkey || '/o' || o_orderkey ELSE '/plain/o' || o_orderkey END AS path
        FROM orders""",
    "real_places": """
        SELECT o_orderkey, o_custkey, p.path,
               CASE o_orderkey % 4 WHEN 0 THEN dir || '/o' || o_orderkey
                    WHEN 1 THEN regexp_replace(dir, '[^/]*$', '') || 'c' || o_custkey || '/o' || o_orderkey
                    ELSE p.path END AS real,
               NOT (o_orderkey % 4 = 2 AND o_custkey % 40 = 7) AS closed
        FROM linked_paths p JOIN link_ends ON n = o_custkey""",
    "action_requests": """
        SELECT l_orderkey AS request_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'rm' WHEN '2-HIGH' THEN 'trash' WHEN '3-MEDIUM' THEN 'open'
                    WHEN '4-NOT SPECIFIED' THEN 'shred' WHEN '5-LOW' THEN 'rm' END AS mode,
               l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos,
               path || '/tmp/.././o' || c_custkey AS path, path || '/o' || c_custkey AS place
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer_dirs ON l_partkey = c_custkey""",
    "articles": r"""
        SELECT doc_id, lang, source,
               replace(replace(replace(replace(replace(text, '$$$', '**'), '***', chr(10) || '# '), '%%%', chr(10) || '- '),
                       '&&&', chr(10) || chr(10)), '###', '？') AS text
        FROM documents""",
    "article_lines": r"""
        SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS n FROM articles""",
    "article_paragraphs": r"""
        SELECT * FROM (SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS paragraph,
               unnest(range(len(string_split_regex(text, '\n[ \t]*\n')))) AS n FROM articles) WHERE trim(paragraph) <> ''""",
    "article_sentences": r"""
        SELECT * FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^。！？.!?\n]+[。！？.!?]*'))) AS sentence,
               unnest(range(len(regexp_extract_all(text, '[^。！？.!?\n]+[。！？.!?]*')))) AS n FROM articles)
        WHERE sentence <> ''""",
    "files": r"""
        SELECT source AS project, '/corpus' AS root,
               CASE lang WHEN 'en' THEN '/corpus/docs/d' || doc_id || '.md' WHEN 'fr' THEN '/corpus/guides/d' || doc_id || '.mdx'
                    WHEN 'de' THEN '/corpus/src/d' || doc_id || '_old.js' ELSE '/corpus/vendor/d' || doc_id || '.md' END AS path,
               text || chr(10) || 'See [next](d' || (doc_id + 1) || '.md) and `docs/d' || (doc_id + 2) || '.md`.' || chr(10) AS text
        FROM documents""",
    "facts": """
        SELECT o_custkey AS topic,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'code' WHEN '2-HIGH' THEN 'runtime' WHEN '3-MEDIUM' THEN 'docs'
                    WHEN '4-NOT SPECIFIED' THEN 'rules' WHEN '5-LOW' THEN 'memory' END AS surface,
               o_orderstatus AS value, o_orderkey AS seq
        FROM orders""",
    "timeline_events": """
        SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS date, o_orderkey AS name,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS trigger FROM orders""",
    "phases": """
        SELECT c_custkey AS subject, p.* FROM customer, (VALUES ('early', DATE '1995-01-01', DATE '1996-12-31'),
            ('late', DATE '1998-01-01', DATE '2001-12-31')) p(phase, start_date, end_date)""",
    "competitors": """
        SELECT p_brand || '/' || p_size AS subject, p_type AS competitor,
               CASE p_type WHEN 'ECONOMY' THEN 'direct' WHEN 'SMALL' THEN 'direct' WHEN 'LARGE' THEN 'direct'
                    WHEN 'PROMO' THEN 'indirect' ELSE 'substitute' END AS type,
               CASE WHEN price < 950 THEN 'low' WHEN price < 1050 THEN 'mid' ELSE 'high' END AS threat, price AS score
        FROM (SELECT p_brand, p_size, p_type, max(p_retailprice) AS price FROM part GROUP BY ALL)""",
    "claims": """
        SELECT l_partkey AS claim_id, l_suppkey AS origin,
               CASE l_returnflag WHEN 'A' THEN 'primary' WHEN 'N' THEN 'media' ELSE 'reprint' END AS source_kind,
               l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS url FROM lineitem""",
    "citations": """
        SELECT s_suppkey AS origin, s_suppkey // 2 AS cites FROM supplier WHERE s_nationkey < 20 AND s_suppkey > 0
        UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_nationkey < 5 AND s_suppkey > 0""",
    "runs": r"""
        SELECT user_id AS run, 'c' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) // 20) AS "check",
               event_id AS seq, event_type NOT IN ('error', 'view') AS ok FROM events""",
    "trigger_labels": """
        SELECT doc_id, text AS query, quality = 1 AS should_trigger, lang FROM labels JOIN documents USING (doc_id)""",
}

_NEEDS = {
    "timeline_items": ["feed_items"],
    "fs_entry": ["customer_dirs"],
    "readable": ["fs_entry"],
    "dirs": ["readable"],
    "targets": ["customer_dirs"],
    "child_sizes": ["targets", "dirs"],
    "tier_prefixes": ["customer_dirs"],
    "tier_items": ["customer_dirs"],
    "all_dirs": ["fs_entry"],
    "grants": ["tier_items", "all_dirs"],
    "link_ends": ["customer_dirs"],
    "real_places": ["linked_paths", "link_ends"],
    "action_requests": ["customer_dirs"],
    "article_lines": ["articles"],
    "article_paragraphs": ["articles"],
    "article_sentences": ["articles"],
}


def with_views(*names: str, body: str) -> str:
    """``body`` with the named views, and those they build on, in front as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    heads = ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    tail = body.strip()
    if not heads:
        return tail
    recursive = ""
    if tail.upper().startswith("WITH RECURSIVE "):
        recursive, tail = "RECURSIVE ", "WITH " + tail[len("WITH RECURSIVE ") :]
    if tail.upper().startswith("WITH "):
        return f"WITH {recursive}{heads}, {tail[5:]}"
    return f"WITH {recursive}{heads} {tail}"
