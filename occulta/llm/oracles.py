"""SQL (DuckDB) for the training-data queries that SQL can express."""

from __future__ import annotations

from . import chat

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.e) = len(r.e))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS node, b AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(least_id, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(least_id, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = e.vec_id LEFT JOIN (SELECT node, min(other) AS least_id FROM reach GROUP BY node) r ON r.node = e.vec_id
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for k, control in enumerate(chat.CONTROLS):
        out = f"replace({out}, '{control}', '{chat.ESCAPE}{chr(97 + k)}')"
    return out


CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)),
w AS (SELECT *, length({_escaped('text')}) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 ELSE 20 + length({_escaped('role')}) END AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(written) AS BIGINT) AS formatted_chars FROM w GROUP BY conv_id
"""

MINHASH = r"""
WITH RECURSIVE d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
u AS (SELECT t, min(doc_id) AS node, count(*) AS copies, any_value(w) AS w FROM d GROUP BY t),
s AS (SELECT node, x, count(*) AS n FROM (SELECT node, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM u) GROUP BY ALL),
total AS (SELECT node, sum(n) AS n FROM s GROUP BY node),
joint AS (SELECT a.node AS a, b.node AS b, sum(least(a.n, b.n)) AS n FROM s a JOIN s b ON a.x = b.x AND a.node <> b.node GROUP BY ALL),
link AS (SELECT a, b FROM joint JOIN total x ON x.node = a JOIN total y ON y.node = b WHERE joint.n >= 0.8 * (x.n + y.n - joint.n)),
reach AS (SELECT a AS node, b AS other FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
class AS (SELECT u.node, u.t, u.copies, least(u.node, coalesce(min(other), u.node)) AS class_id FROM u LEFT JOIN reach USING (node) GROUP BY u.node, u.t, u.copies)
SELECT d.doc_id, class_id, class_size, d.doc_id = class_id AS kept FROM d JOIN class USING (t) JOIN (SELECT class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM class GROUP BY class_id) USING (class_id)
"""

HARD_NEGATIVES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.e, r.e) AS BIGINT) AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(a.e) = len(r.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


def merkle(levels: int = 8) -> str:
    """Digests of rows, of runs of eight up to their group's, and of groups' up to the root; enough for ``8 ** levels`` rows a group."""
    written = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
    # the check sum, bit by bit
    bits = "flatten(list_transform(regexp_extract_all(CAST(doc_id AS VARCHAR), '.'), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({bits}, lambda b: CAST(b AS BIGINT))), lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"l AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({written.format(text='text')}) AS h, sha256({written.format(text=lowered)}) AS t, coalesce({crc} % 3 = 0, false) AS bad FROM documents)",
        "n0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, row_number() OVER () AS r FROM l)",
        "d0 AS MATERIALIZED (SELECT r, g, i, '' AS proof, CASE WHEN bad THEN t ELSE h END AS fold FROM n0)",
        "a0 AS MATERIALIZED (SELECT g, i, h FROM n0)",
    ]

    def climb(a: str, d: str, k: int) -> None:
        beside = "array_to_string(hs[1:i % 8], '')", "array_to_string(hs[i % 8 + 2:], '')"
        parts.append(f"{a}r{k} AS MATERIALIZED (SELECT g, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {a}{k}) GROUP BY g, i // 8)")
        parts.append(f"{a}{k + 1} AS MATERIALIZED (SELECT g, run AS i, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {a}r{k})")
        parts.append(f"{d}{k + 1} AS MATERIALIZED (SELECT r, d.g, d.i // 8 AS i, proof || {beside[0]} || {beside[1]} AS proof, CASE WHEN n = 1 THEN fold ELSE sha256({beside[0]} || fold || {beside[1]}) END AS fold FROM {d}{k} d JOIN {a}r{k} x ON d.g = x.g AND d.i // 8 = run)")

    for k in range(levels):
        climb("a", "d", k)
    parts.append(f"b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS name FROM a{levels})")
    parts.append(f"e0 AS MATERIALIZED (SELECT r, '' AS g, b0.i, proof, fold FROM d{levels} d JOIN b0 ON b0.name = d.g)")
    for k in range(levels):
        climb("b", "e", k)
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, n0.h AS leaf, b0.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.h AS verified
    FROM n0 JOIN e{levels} e USING (r) JOIN b0 ON b0.name = n0.g, b{levels} top"""
