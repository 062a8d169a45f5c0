"""SQL twin of a few boosting rounds, level by level, for the cross-check."""

from __future__ import annotations

UNIT = 1 << 20


def edges_sql(source: str, features: list[str], bins: int) -> str:
    probs = ", ".join(f"{i / bins!r}" for i in range(1, bins))
    return " UNION ALL ".join(f"SELECT {k} AS f, list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{probs}]))) AS e FROM {source}"
                              for k, c in enumerate(features))


def boosting_sql(source: str, features: list[str], start: str, rounds: int, depth: int, bins: int, step: float, l2: float,
                 folds: str | None = None) -> str:
    """Common tables from ``edges`` to ``boosted`` (row_key, j, fold, y, m, src_ip). ``start`` is the margin to begin with,
    ``folds`` a column: one model per value, trained on the rows of the other values."""
    n = len(features)
    bs = ", ".join(f"b{k}" for k in range(n))
    cut = lambda k, c: f"len(list_filter((SELECT e FROM edges WHERE f = {k}), lambda e: e <= CAST({c} AS DOUBLE))) AS b{k}"
    out = [f"edges AS MATERIALIZED ({edges_sql(source, features, bins)})",
           f"binned AS MATERIALIZED (SELECT row_key, src_ip, CAST(label <> 'BENIGN' AS INTEGER) AS y, {folds or 'NULL'} AS fold, CAST({start} AS DOUBLE) AS m, "
           + ", ".join(cut(k, c) for k, c in enumerate(features)) + f" FROM {source})",
           f"models AS MATERIALIZED (SELECT DISTINCT {folds} AS j FROM {source})" if folds else "models AS MATERIALIZED (SELECT CAST(NULL AS VARCHAR) AS j)",
           f"m0 AS MATERIALIZED (SELECT row_key, src_ip, y, fold, coalesce(j, '') AS j, j IS NULL OR fold <> j AS train, m, {bs} FROM binned, models)"]
    for r in range(rounds):
        out.append(f"""g{r} AS MATERIALIZED (SELECT *, CAST(floor((p - y) * {UNIT} + 0.5) AS BIGINT) AS g, CAST(floor(p * (1.0 - p) * {UNIT} + 0.5) AS BIGINT) AS h
  FROM (SELECT *, 1.0 / (1.0 + exp(-m)) AS p FROM m{r}))""")
        out.append(f"""l{r}_0 AS MATERIALIZED (SELECT g{r}.*, 0 AS node, v AS val FROM g{r} JOIN (SELECT j, -(sum(g) / {UNIT}.0) / (sum(h) / {UNIT}.0 + {l2}) * {step} AS v
  FROM g{r} WHERE train GROUP BY j) USING (j))""")
        for d in range(depth):
            long = " UNION ALL ".join(f"SELECT j, node, {k} AS f, b{k} AS b, g, h FROM l{r}_{d} WHERE train AND node >= {(1 << d) - 1}" for k in range(n))
            out.append(f"h{r}_{d} AS MATERIALIZED (SELECT j, node, f, b, sum(g) / {UNIT}.0 AS g, sum(h) / {UNIT}.0 AS h FROM ({long}) GROUP BY ALL)")
            gain = lambda g, h: f"({g}) * ({g}) / (({h}) + {l2})"
            out.append(f"""s{r}_{d} AS MATERIALIZED (SELECT * FROM (SELECT *, {gain('gl', 'hl')} + {gain('ga - gl', 'ha - hl')} - {gain('ga', 'ha')} AS gain,
    row_number() OVER (PARTITION BY j, node ORDER BY {gain('gl', 'hl')} + {gain('ga - gl', 'ha - hl')} - {gain('ga', 'ha')} DESC, f, b) AS place
    FROM (SELECT j, node, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY j, node, f) AS ga, sum(h) OVER (PARTITION BY j, node, f) AS ha
      FROM h{r}_{d} WINDOW w AS (PARTITION BY j, node, f ORDER BY b)) WHERE hl >= 1.0 AND ha - hl >= 1.0) WHERE place = 1 AND gain > 0)""")
            goes = "CASE s.f " + " ".join(f"WHEN {k} THEN l.b{k}" for k in range(n)) + " END > s.b"
            leaf = lambda g, h: f"-({g}) / (({h}) + {l2}) * {step}"
            out.append(f"""l{r}_{d + 1} AS MATERIALIZED (SELECT l.* REPLACE (
    CASE WHEN s.f IS NULL THEN l.node WHEN {goes} THEN 2 * l.node + 2 ELSE 2 * l.node + 1 END AS node,
    CASE WHEN s.f IS NULL THEN l.val WHEN {goes} THEN {leaf('s.ga - s.gl', 's.ha - s.hl')} ELSE {leaf('s.gl', 's.hl')} END AS val)
  FROM l{r}_{d} l LEFT JOIN s{r}_{d} s ON l.j = s.j AND l.node = s.node)""")
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT row_key, src_ip, y, fold, j, train, m + val AS m, {bs} FROM l{r}_{depth})")
    out.append(f"boosted AS (SELECT * FROM m{rounds})")
    return ",\n".join(out)
