"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS r,
                     first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
        SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g
    """,
    "op6_warc": r"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM f
    """,
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 13) AS q FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(q) AS n FROM win),
        spots AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
        occ AS (SELECT DISTINCT doc_id, item_id, i, n FROM (SELECT doc_id, i, n, list_slice(w, i + 1, i + n) AS q FROM spots) s JOIN win USING (q)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op3_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i + 1, i + 4), ' ')) AS g
              FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
        r AS (SELECT x AS doc_id, y AS o FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.o, d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id) m USING (doc_id)
    """,
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, i, hash(array_slice(b, i + 1, i + 200)) AS h FROM (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
        c AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
        s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN c USING (h)),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
        r AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY ALL),
        p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM r UNION ALL SELECT doc_id, max(z), NULL FROM r GROUP BY 1),
        k AS (SELECT p.doc_id, sha256(unhex(string_agg(CASE WHEN coalesce(y, n) > x THEN hex(array_slice(b, x + 1, coalesce(y, n))) ELSE '' END, '' ORDER BY x))) AS h FROM p JOIN d USING (doc_id) GROUP BY 1),
        t AS (SELECT doc_id, sum(z - a) AS m, count(*) AS c FROM r GROUP BY 1)
        SELECT doc_id, n AS n_bytes, coalesce(m, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, coalesce(k.h, sha256(b)) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
}
