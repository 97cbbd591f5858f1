"""SQL twins of the queries that SQL can express: each says the contract plainly, by comparing everything with everything.

The others have none: op2, op4, op5, op7, op8 and op9 rest on keyed permutations, merge ranks, a parser, a fitted model or
XXH64, which DuckDB lacks. `tests/llm` holds them against brute force, planted values, hand-made pages or held-out accuracy.
"""

SUBSTRINGS = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, spot, array_to_string(words[spot : spot + 12], ' ') AS words13
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS spot FROM cut)
), firsts AS (
  SELECT words13, min(doc_id) AS first_doc FROM windows GROUP BY words13
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(spot, spot + 13)) AS spot
  FROM windows JOIN firsts USING (words13) WHERE first_doc < doc_id
), every_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS spot FROM cut
), told AS (
  SELECT e.doc_id, count(g.spot) AS n_removed, string_agg(e.word, ' ' ORDER BY e.spot) FILTER (WHERE g.spot IS NULL) AS kept
  FROM every_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.spot = e.spot GROUP BY e.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN told USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = list_count(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reached.vec_id, links.b FROM reached JOIN links ON links.a = reached.other
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reached LEFT JOIN counted USING (vec_id) GROUP BY vec_id
"""

WARC = """
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_page FROM pages
), hashed AS (
  SELECT *, sha1(payload) AS digest FROM paid
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(digest, (1 + 5 * (k // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_page THEN last_page END AS refers_to, true AS complete
FROM hashed
"""

PASSAGES = """
WITH coded AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
), blocks AS (
  SELECT doc_id, block, substr(digits, 1000 * block + 1, 1098) AS part
  FROM (SELECT doc_id, digits, unnest(range(strlen(digits) // 1000 + 1)) AS block FROM coded)
), strings AS (
  SELECT doc_id, 500 * block + spot AS spot, substr(part, 2 * spot + 1, 100) AS bytes50
  FROM (SELECT doc_id, block, part, unnest(range(strlen(part) // 2 - 49)) AS spot FROM blocks)
), firsts AS (
  SELECT bytes50, min(doc_id) AS first_doc FROM strings GROUP BY bytes50
), hits AS (
  SELECT doc_id, spot, lag(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS before
  FROM strings JOIN firsts USING (bytes50) WHERE first_doc < doc_id
), spans AS (
  SELECT doc_id, min(spot) AS first_byte, max(spot) + 50 AS end_byte
  FROM (SELECT doc_id, spot, sum(CASE WHEN spot <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY spot) AS span FROM hits)
  GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, end_byte AS piece, coalesce(lead(first_byte) OVER (PARTITION BY doc_id ORDER BY first_byte), strlen(digits) // 2) AS stop
  FROM spans JOIN coded USING (doc_id)
  UNION ALL
  SELECT doc_id, 0, coalesce(min(first_byte), any_value(strlen(digits)) // 2) FROM coded LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), told AS (
  SELECT doc_id, string_agg(substr(digits, 2 * piece + 1, 2 * (stop - piece)), '' ORDER BY piece) AS kept
  FROM pieces JOIN coded USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_spans, sum(end_byte - first_byte) AS n_removed FROM spans GROUP BY doc_id
)
SELECT doc_id, (strlen(digits) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM coded JOIN told USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substrings": SUBSTRINGS, "op3_vectors": VECTORS, "op6_warc": WARC, "op10_passages": PASSAGES}
