"""DuckDB equivalents of the queries that SQL can express."""

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(norm) AS text_sha256
        FROM n JOIN g USING (norm)
    """,
    "op8_warc_revisits": r"""
        WITH w AS (
            SELECT page_id AS p, k, md5(html) AS digest, 1704067200 + (page_id * 7919) % 2592000 AS start,
                   regexp_replace(trim(url), '#.*$', '') AS u
            FROM pages, range(0, 5) AS t(k)
        ), parts AS (
            SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
                   regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), '^www\.', '') AS host,
                   regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)='))), '&') AS params
            FROM w
        ), rows AS (
            SELECT p * 10 + k AS record_id, p, k, digest, start,
                   CASE WHEN scheme <> '' AND host <> '' THEN '//' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '')
                       WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END || path
                       || CASE WHEN params <> '' THEN '?' || params ELSE '' END END AS canon,
                   start + CASE WHEN k = 3 AND p % 13 = 0 THEN -3600 WHEN k = 4 THEN 9000 ELSE k * (p % 5 + 1) * 1800 END AS moment,
                   CASE WHEN k = 0 OR (k = 4 AND p % 3 = 0) THEN 200 ELSE 304 END AS status,
                   CASE WHEN p % 7 = 0 OR (k = 3 AND p % 4 = 1) THEN NULL
                        WHEN k = 2 AND p % 11 = 0 THEN 'W/"' || substr(digest, 17, 16) || '"'
                        ELSE CASE WHEN k = 1 AND p % 2 = 0 THEN 'W/' ELSE '' END || '"' || substr(digest, 1, 16)
                             || CASE WHEN k = 4 THEN '-b' ELSE '' END || '"' END AS tag,
                   CASE WHEN k = 3 AND p % 4 = 1 THEN NULL
                        ELSE CAST(start - 86400 + CASE WHEN k = 2 AND p % 14 = 0 THEN 60 ELSE 0 END AS VARCHAR) END AS modified
            FROM parts
        ), found AS (
            SELECT r.record_id, max({'at': f.moment, 'id': f.record_id}).id AS full_id
            FROM rows r JOIN rows f ON f.canon = r.canon AND f.moment < r.moment AND f.status = 200
            WHERE r.status = 304 GROUP BY r.record_id
        ), j AS (
            SELECT r.*, f.full_id, o.tag AS old_tag, o.modified AS old_modified,
                   r.tag IS NOT NULL AND o.tag IS NOT NULL AS tags,
                   NOT (r.tag IS NOT NULL AND o.tag IS NOT NULL) AND r.modified IS NOT NULL AND o.modified IS NOT NULL AS dates
            FROM rows r LEFT JOIN found f USING (record_id) LEFT JOIN rows o ON o.record_id = f.full_id WHERE r.status = 304
        ), v AS (
            SELECT *, CASE WHEN canon IS NULL THEN 'no_url' WHEN full_id IS NULL THEN 'missing'
                WHEN CASE WHEN tags THEN regexp_replace(tag, '^W/', '') = regexp_replace(old_tag, '^W/', '')
                          WHEN dates THEN modified = old_modified ELSE true END THEN 'resolved' ELSE 'changed' END AS verdict
            FROM j
        )
        SELECT record_id, canon AS canonical_url, full_id, verdict,
               CASE WHEN verdict = 'resolved' THEN CASE WHEN tags THEN 'etag' WHEN dates THEN 'last-modified' ELSE 'none' END END AS matched_by,
               CASE WHEN verdict = 'resolved' THEN array_to_string(list_sort(list_filter([
                   'cache-control=max-age=' || k * 60, 'content-length=512', 'content-type=text/html', 'date=' || moment,
                   'etag=' || coalesce(tag, old_tag), 'last-modified=' || coalesce(modified, old_modified)], lambda x: x IS NOT NULL)), ';') END AS headers
        FROM v
    """,
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w
        ), x AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
        )
        SELECT doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(other) FROM reached r WHERE r.doc_id = s.doc_id) AS component_id FROM s
    """,
    "op11_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base,
                   (4294967295 - list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
                       list_reduce(range(0, 8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)), 4294967295::BIGINT)) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ), path AS (
            SELECT i.conv_id, t.pos, role, text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos <= h
            UNION ALL
            SELECT i.conv_id, t.pos, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.pos > h
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, md5(length(role) || ':' || role || text) AS turn FROM path
        ), passed AS (
            SELECT conv_id, d, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node,
                   len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM placed
            UNION ALL SELECT conv_id, 0, 'root', 0 FROM ids
        ), ends AS (SELECT conv_id, max(d) AS last FROM passed GROUP BY 1),
        nodes AS (
            SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = last), '') AS ended
            FROM passed JOIN ends USING (conv_id) GROUP BY node, d
        ), own AS (SELECT n.node, n.d, n.saved, p.conv_id FROM nodes n JOIN passed p ON p.node = n.node AND p.conv_id = n.conv_id),
        links AS (SELECT o.node, p.node AS parent FROM own o JOIN passed p ON p.conv_id = o.conv_id AND p.d = o.d - 1),
        children AS (SELECT parent AS node, count(*) AS n FROM links GROUP BY 1),
        sums AS (
            SELECT p.node, sum(o.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
            FROM own o JOIN passed p ON p.conv_id = o.conv_id AND p.d <= o.d LEFT JOIN children c ON c.node = o.node GROUP BY p.node
        )
        SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
               s.saved::BIGINT AS saved_tokens, sha256(n.ended) AS ends_sha256
        FROM nodes n JOIN sums s USING (node) LEFT JOIN children c ON c.node = n.node LEFT JOIN links l ON l.node = n.node LEFT JOIN nodes p ON p.node = l.parent
    """,
}
