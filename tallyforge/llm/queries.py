"""The queries of this package as registered, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import clustering, line_dedup, lm_scoring, mixing, neighbours, sentencepiece_dropout, sharding, simhash, suffix_dedup, token_output, toxicity, vectors

QUERIES = {
    "op1_cover_tree": vectors.op1,
    "op2_sharding": sharding.op2,
    "op3_simhash": simhash.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_top_k": neighbours.op5,
    "op6_sentencepiece": sentencepiece_dropout.op6,
    "op7_suffix_dedup": suffix_dedup.op7,
    "op8_token_output": token_output.op8,
    "op9_mixing": mixing.op9,
    "op10_toxicity": toxicity.op10,
    "op11_clustering": clustering.op11,
    "op12_hard_negatives": neighbours.op12,
    "op13_lm_scoring": lm_scoring.op13,
}

_FLOORED = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"
_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ORACLES: dict[str, str] = {
    "op1_cover_tree": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_VALID} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op5_top_k": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_VALID}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}


def _lloyd(rounds: int) -> str:
    """Lloyd's rounds, each a pair of tables: the nearest centroids, and the means of their vectors."""
    steps = [f"v AS MATERIALIZED (SELECT vec_id, {_FLOORED} AS e FROM embeddings WHERE {_VALID} AND len(embedding) = 64)"]
    steps.append("c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, e AS c FROM (SELECT e, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT 40))")
    for i in range(rounds + 1):
        gap = "list_inner_product(e, e) + list_inner_product(c, c) - 2 * list_inner_product(e, c)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, e, k, d FROM (SELECT vec_id, e, k, ({gap})::BIGINT AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {gap}, k) AS r FROM v, c{i}) WHERE r = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT k, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(e)::BIGINT AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY ALL)")
            steps.append(f"f{i} AS (SELECT k, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY pos) AS c FROM m{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(f{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN f{i} USING (k))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


ORACLES["op11_clustering"] = _lloyd(5)
ORACLES["op12_hard_negatives"] = f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, {_FLOORED} AS e FROM embeddings WHERE label IS NOT NULL AND {_VALID}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.l = b.l AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
