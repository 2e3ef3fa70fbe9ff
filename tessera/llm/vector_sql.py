"""DuckDB SQL of the operators on vectors: every round spelled out, every vector compared with every centre."""

from __future__ import annotations


def _kept(where: str, scale: int) -> str:
    good = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {good} AND {where}"


def _floor(s: str, n: str) -> str:
    """The floor of an exact quotient."""
    return f"(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"


def sort_means(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    away = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT"
    steps = [f"x AS MATERIALIZED ({_kept(f'len(embedding) = {dims}', 1024)})"]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) - 1 AS c, v FROM x ORDER BY sha256('3:' || vec_id), vec_id LIMIT {k})")
    for i in range(rounds + 1):
        near = f"SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT x.r, c.c, {away} AS d FROM x, c{i} c) GROUP BY r"
        steps.append(f"a{i} AS MATERIALIZED ({near})")
        if i < rounds:
            mean = _floor("sum(v[i])::HUGEINT", "count(*)")
            place = f"SELECT c, i, {mean} AS m FROM (SELECT a.c, v, unnest(range(1, {dims + 1})) AS i FROM a{i} a JOIN x USING (r)) GROUP BY c, i"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(m::BIGINT ORDER BY i) AS v FROM ({place}) GROUP BY c) n USING (c))")
    last = rounds
    return (
        f"WITH {', '.join(steps)}\nSELECT x.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{last} a JOIN x USING (r) JOIN c{last} c USING (c)"
    )


def heap_lloyd(parts: int = 8, entries: int = 16, rounds: int = 6, dims: int = 64) -> str:
    w = dims // parts
    away = f"list_sum(list_transform(range(1, {w + 1}), lambda i: (x.v[i] - e.v[i]) * (x.v[i] - e.v[i])))::BIGINT"
    steps = [f"k AS MATERIALIZED ({_kept(f'len(embedding) = {dims}', 4096)})"]
    steps.append(f"x AS MATERIALIZED (SELECT r, p, v[p * {w} + 1:(p + 1) * {w}] AS v FROM (SELECT r, v, unnest(range(0, {parts})) AS p FROM k))")
    steps.append(f"e0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {entries})")
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (SELECT x.r, x.p, e.e, {away} AS d FROM x JOIN e{i} e USING (p)) GROUP BY r, p)")
        if i < rounds:
            mean = _floor("sum(v[i])::HUGEINT", "count(*)")
            place = f"SELECT p, e, i, {mean} AS m FROM (SELECT a.p, a.e, v, unnest(range(1, {w + 1})) AS i FROM a{i} a JOIN x USING (r, p)) GROUP BY p, e, i"
            steps.append(f"e{i + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(n.v, o.v) AS v FROM e{i} o LEFT JOIN (SELECT p, e, list(m::BIGINT ORDER BY i) AS v FROM ({place}) GROUP BY p, e) n USING (p, e))")
    each = f"SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r"
    book = f"SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM e{rounds}"
    return f"WITH {', '.join(steps)}\nSELECT k.vec_id, lower(s.code) AS code, s.error, sum(s.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, ({book}) AS codebooks_sha256 FROM ({each}) s JOIN k USING (r)"
