"""DuckDB SQL for the queries that it can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda y: y <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), reached(d, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT links.y, reached.c FROM reached JOIN links ON links.x = reached.d
), least AS (
    SELECT d, min(c) AS c FROM reached GROUP BY d
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, documents.doc_id = c AS kept
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id JOIN least ON least.d = documents.doc_id
"""

WARC = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
    SELECT digest, min(page_id) AS first FROM payloads WHERE n >= 100 GROUP BY digest
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.digest = f.digest AND p.n >= 100
"""

TOPK = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
    FROM vectors q JOIN vectors v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_GUARD = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '\<s>'), '</s>', '\</s>'), '[INST]', '\[INST]'), '[/INST]', '\[/INST]')"

CHAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(length('<s>[INST]' || {_GUARD.format("role")} || '[/INST]' || {_GUARD.format("text")} || '</s>' || chr(10))) AS formatted
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM joined
"""

JACCARD_JOIN = NEAR_DUPLICATES.replace("80 *", "85 *").replace(", documents.doc_id = c AS kept", "")


def _rounds(rounds: int) -> str:
    """Assignments a0, a1, ... and centroids c1, c2, ... of each round."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
), a{k} AS MATERIALIZED (
    SELECT r, min({{'d': list_inner_product(v.x, v.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(v.x, c.x), 'k': c.k}}) AS best FROM kept v, c{k} c GROUP BY r"""
        if k < rounds:
            steps += f"""
), c{k + 1} AS MATERIALIZED (
    SELECT c.k, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
        SELECT k, list(floor(s / n) ORDER BY i) AS x FROM (SELECT a.best.k AS k, i, sum(v.x[i]) AS s, count(*) AS n FROM a{k} a JOIN kept v USING (r), range(1, 65) t(i) GROUP BY ALL) GROUP BY k
    ) m ON m.k = c.k"""
    return steps


CENTROIDS = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor(256 * CAST(y AS DOUBLE))) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
), c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 40){_rounds(5)}
)
SELECT vec_id, a.best.k AS cluster, CAST(a.best.d AS BIGINT) AS distance, CAST(sum(a.best.d) OVER (PARTITION BY a.best.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a5 a JOIN kept USING (r) JOIN c5 c ON c.k = a.best.k
"""
