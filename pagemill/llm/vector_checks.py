"""SQL that checks the two operators on whole vectors, written out round by round."""

from __future__ import annotations

_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"


def _whole(scale: int, length: str) -> str:
    finite = "len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
    return f"""kept AS MATERIALIZED (
        SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
        FROM embeddings WHERE embedding IS NOT NULL AND {length} AND {finite}
    ), x AS MATERIALIZED (SELECT vec_id, unnest(range(len(v))) AS pos, unnest(v) AS val FROM kept)"""


def clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    hashed = f"sha256('{seed}:' || vec_id)"
    steps = [
        _whole(scale, f"len(embedding) = {dims}"),
        f"""c0 AS MATERIALIZED (
            SELECT c, unnest(range({dims})) AS pos, unnest(v) AS val
            FROM (SELECT row_number() OVER (ORDER BY {hashed}) - 1 AS c, v FROM kept ORDER BY {hashed} LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
            SELECT vec_id, c, sum((x.val - k.val) * (x.val - k.val)) AS d FROM x JOIN c{r} AS k USING (pos) GROUP BY vec_id, c
        ), a{r} AS MATERIALIZED (SELECT vec_id, min(d * {k} + c) % {k} AS c, min(d * {k} + c) // {k} AS d FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT o.c, o.pos, coalesce({_FLOOR}, o.val) AS val FROM c{r} AS o
                LEFT JOIN (SELECT c, pos, sum(val) AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id) GROUP BY c, pos) AS m
                ON m.c = o.c AND m.pos = o.pos)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               h.digest AS centroid_sha256
        FROM a{rounds} AS a
        JOIN (SELECT c, sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY pos)) AS digest FROM c{rounds} GROUP BY c) AS h ON h.c = a.c"""


def coding_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, dims: int = 64) -> str:
    width = dims // parts
    steps = [
        _whole(scale, f"len(embedding) = {dims}"),
        f"""b0 AS MATERIALIZED (
            SELECT e, unnest(range({dims})) AS pos, unnest(v) AS val
            FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
            SELECT vec_id, x.pos // {width} AS part, e, sum((x.val - b.val) * (x.val - b.val)) AS d
            FROM x JOIN b{r} AS b USING (pos) GROUP BY vec_id, x.pos // {width}, e
        ), a{r} AS MATERIALIZED (
            SELECT vec_id, part, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d
            FROM d{r} GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
                SELECT o.e, o.pos, coalesce({_FLOOR}, o.val) AS val FROM b{r} AS o
                LEFT JOIN (
                    SELECT a.e, x.pos, sum(val) AS s, count(*) AS n FROM x JOIN a{r} AS a ON a.vec_id = x.vec_id AND a.part = x.pos // {width}
                    GROUP BY a.e, x.pos) AS m
                ON m.e = o.e AND m.pos = o.pos)""")
    return f"""WITH {", ".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY pos // {width}, e, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""
