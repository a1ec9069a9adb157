"""The queries of the pipeline operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, license_scan, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_counts, url_filters, warc



def pipeline(spark, sf_dir: str):
    """All stages of corpus_pipeline.py, at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc": warc.op2_warc,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_sharding": sharding.op10_sharding,
    "pipeline": pipeline,
}

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op2_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x || '0', (5 * i) // 4 + 1, 2) AS INT) >> (3 - (5 * i) % 4)) & 31), 1) FOR i IN range(32)], '') AS payload_digest FROM s),
f AS (SELECT payload_digest, min(page_id) AS least FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM d JOIN f USING (payload_digest)""",
    "op3_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[j] || ' ' || w[j + 1] FOR j IN range(1, len(w))] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = w.doc_id""",
    "op5_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, j, ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS r(j) WHERE len(ws) >= 3),
rep AS (SELECT doc_id, j FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), cov AS (SELECT DISTINCT doc_id, j + k AS p FROM rep, unnest(range(0, 3)) AS r(k)), cr AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
ln AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM w),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cr.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals
  FROM w JOIN ln USING (doc_id) LEFT JOIN cr USING (doc_id)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT + 8 * (n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT + 32 * (100 * n_capitals > 40 * word_chars)::INT AS f FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, f & 3 > 0 AS base_failed, f = 0 AS kept, CAST(f AS BIGINT) AS failed_rules FROM b""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS r(i) WHERE len(ws) >= 50),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, 50)) AS r(k)),
kept AS (SELECT w.doc_id, string_agg(ws[j], ' ' ORDER BY j) AS kept, count(*) AS n FROM w, unnest(range(1, len(ws) + 1)) AS r(j)
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.p = j WHERE gone.p IS NULL GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
}
