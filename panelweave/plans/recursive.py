"""DuckDB SQL of queries that are sequential: recursive statements, a row of state per step.

Each takes the names of relations that the caller's WITH list has (``sim`` or ``graph`` with ``src, dst,
w``; ``nodes``; ``panel``), and returns further entries of that list, the last of them ``out``."""

from __future__ import annotations

LINKS = "links AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph)"


def dtw(window: int, limit: float | None = None) -> str:
    """Banded alignment by anti-diagonals: a step has the cells of two diagonals."""
    pruned = f"CASE WHEN b.w > {limit} THEN b.w ELSE sqrt(a.c) END" if limit is not None else "sqrt(a.c)"
    bounds = f"""
    env AS (SELECT t, node, max(value) OVER f AS hi, min(value) OVER f AS lo FROM panel WINDOW f AS (PARTITION BY node ORDER BY t ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING)),
    bound AS (SELECT p.node AS src, e.node AS dst, sqrt(sum(power(greatest(value - hi, lo - value, 0), 2))) AS w FROM panel p JOIN env e ON p.t = e.t AND p.node < e.node GROUP BY 1, 2),"""
    return f"""size AS (SELECT max(t) + 1 AS n FROM panel), {bounds}
    cost AS (SELECT a.node AS src, b.node AS dst, a.t + 1 AS i, b.t + 1 AS j, power(a.value - b.value, 2) AS c FROM panel a JOIN panel b ON a.node < b.node AND b.t - a.t BETWEEN -{window} AND {window} - 1),
    walk(step, src, dst, i, j, c) AS (
      SELECT 0, src, dst, 0, 0, 0.0::DOUBLE FROM (SELECT DISTINCT src, dst FROM cost)
      UNION ALL
      SELECT r.step + 1, r.src, r.dst, r.i + m.di, r.j + m.dj, min(r.c) + coalesce(max(k.c), 0)
      FROM walk r CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) m(di, dj)
      LEFT JOIN cost k ON k.src = r.src AND k.dst = r.dst AND k.i = r.i + m.di AND k.j = r.j + m.dj AND m.di + m.dj > 0
      WHERE CASE WHEN m.di + m.dj = 0 THEN r.i + r.j = r.step ELSE r.i + m.di + r.j + m.dj = r.step + 1 AND k.c IS NOT NULL END AND r.step < 2 * (SELECT n FROM size)
      GROUP BY ALL),
    half AS (SELECT a.src, a.dst, 1 / (1 + {pruned}) AS w FROM walk a JOIN bound b USING (src, dst) WHERE a.step = 2 * (SELECT n FROM size) AND a.i = (SELECT n FROM size) AND a.j = a.i),
    out AS (SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half UNION ALL SELECT node, node, 1.0 FROM nodes)"""


def greedy_degree(k: int, penalty: float) -> str:
    """The pair of the largest |w| - penalty (deg_i + deg_j), k times."""
    return f"""cells AS (SELECT src, dst, abs(w) AS w FROM sim WHERE src < dst),
    pick(step, src, dst, taken) AS (
      SELECT 0, -1, -1, []::INTEGER[]
      UNION ALL
      SELECT step + 1, best.src, best.dst, taken || [best.src * 1000 + best.dst]
      FROM (SELECT p.step, p.taken, arg_max({{'src': c.src, 'dst': c.dst}}, c.w - {penalty} * (len(list_filter(p.taken, lambda x: x // 1000 = c.src OR x % 1000 = c.src)) + len(list_filter(p.taken, lambda x: x // 1000 = c.dst OR x % 1000 = c.dst)))) AS best
            FROM pick p, cells c WHERE p.step < {k} AND NOT list_contains(p.taken, c.src * 1000 + c.dst) GROUP BY 1, 2)),
    out AS (SELECT src, dst FROM pick WHERE step > 0 UNION ALL SELECT dst, src FROM pick WHERE step > 0)"""


def dhondt(k: int, by_sum: bool) -> str:
    """The row of the largest quotient takes its best free cell, k times; both ends then count one more."""
    degree = "len(list_filter(p.taken, lambda x: x // 1000 = c.src)) + len(list_filter(p.taken, lambda x: x % 1000 = c.src)) + 1"
    return f"""cells AS (SELECT src, dst, abs(w) AS w, sum(abs(w)) OVER (PARTITION BY src) AS total FROM sim WHERE src <> dst),
    pick(step, src, dst, taken) AS (
      SELECT 0, -1, -1, []::INTEGER[]
      UNION ALL
      SELECT step + 1, best.src, best.dst, taken || [best.src * 1000 + best.dst]
      FROM (SELECT step, taken, arg_max(best, q) AS best
            FROM (SELECT p.step, p.taken, c.src, arg_max({{'src': c.src, 'dst': c.dst}}, {{'w': c.w, 'd': c.dst}}) AS best, max({"c.total" if by_sum else "c.w"}) / max({degree}) AS q
                  FROM pick p, cells c WHERE p.step < {k} AND NOT list_contains(p.taken, c.src * 1000 + c.dst) GROUP BY 1, 2, 3) GROUP BY 1, 2)),
    out AS (SELECT src, dst FROM pick WHERE step > 0)"""


def partial_correlation(n: int) -> str:
    """The covariance swept on every node, 0 to n - 1, gives minus its inverse."""
    out = ["s0 AS (SELECT a.node AS i, b.node AS j, covar_samp(a.value, b.value) AS w FROM panel a JOIN panel b USING (t) GROUP BY 1, 2)"]
    for k in range(n):
        out.append(f"""s{k + 1} AS (SELECT x.i, x.j, CASE WHEN x.i = {k} AND x.j = {k} THEN -1 / p.w WHEN x.i = {k} OR x.j = {k} THEN x.w / p.w ELSE x.w - r.w * c.w / p.w END AS w
          FROM s{k} x JOIN s{k} p ON p.i = {k} AND p.j = {k} JOIN s{k} r ON r.i = x.i AND r.j = {k} JOIN s{k} c ON c.i = {k} AND c.j = x.j)""")
    out.append(f"out AS (SELECT x.i AS src, x.j AS dst, CASE WHEN x.i = x.j THEN 1.0 ELSE x.w / sqrt(a.w * b.w) END AS w FROM s{n} x JOIN s{n} a ON a.i = x.i AND a.j = x.i JOIN s{n} b ON b.i = x.j AND b.j = x.j)")
    return ", ".join(out)


def k_hop(most: int) -> str:
    """One hop: the lowest free node takes the free nodes next to it, itself first, up to ``most``."""
    return f"""{LINKS}, near AS (SELECT node AS seed, node, 0 AS hop FROM nodes UNION SELECT src, dst, 1 FROM links WHERE src <> dst),
    pick(batch_id, batch, used) AS (
      SELECT -1, []::INTEGER[], []::INTEGER[]
      UNION ALL
      SELECT batch_id + 1, batch, used || batch
      FROM (SELECT p.batch_id, p.used, list_slice(list(near.node ORDER BY hop, near.node), 1, {most}) AS batch
            FROM pick p, near WHERE NOT list_contains(p.used, near.node) AND near.seed = (SELECT min(n.node) FROM nodes n WHERE NOT list_contains(p.used, n.node)) GROUP BY 1, 2)),
    out AS (SELECT batch_id, unnest(range(len(batch))) AS pos, unnest(batch) AS node FROM pick WHERE batch_id >= 0)"""


def greedy_cluster(most: int) -> str:
    """A batch grows by the free node with the strongest edge from any member; else a new one begins."""
    return f"""pick(step, batch_id, pos, node, batch, used) AS (
      SELECT 0, 0, 0, min(node), [min(node)], [min(node)] FROM nodes
      UNION ALL
      SELECT step + 1, CASE WHEN grow THEN batch_id ELSE batch_id + 1 END, CASE WHEN grow THEN pos + 1 ELSE 0 END, nxt, CASE WHEN grow THEN batch || [nxt] ELSE [nxt] END, used || [nxt]
      FROM (SELECT step, batch_id, pos, batch, used, coalesce(max(reach), 0) > 0 AND len(batch) < {most} AS grow, CASE WHEN coalesce(max(reach), 0) > 0 AND len(batch) < {most} THEN arg_max(free, {{'r': reach, 'd': -free}}) ELSE min(free) END AS nxt
            FROM (SELECT p.step, p.batch_id, p.pos, p.batch, p.used, n.node AS free, coalesce(max(CASE WHEN list_contains(p.batch, g.src) THEN g.w END), 0) AS reach
                  FROM pick p JOIN nodes n ON NOT list_contains(p.used, n.node) LEFT JOIN graph g ON g.dst = n.node GROUP BY 1, 2, 3, 4, 5, 6)
            GROUP BY 1, 2, 3, 4, 5)),
    out AS (SELECT batch_id, pos, node FROM pick)"""


def degree_aware(base: int, scale: float) -> str:
    """By falling weighted degree, each free node takes its strongest free neighbours."""
    return f"""u AS (SELECT a AS src, b AS dst, CASE WHEN lower IS NOT NULL AND upper IS NOT NULL THEN lower ELSE coalesce(lower, upper) END AS w
      FROM (SELECT greatest(src, dst) AS a, least(src, dst) AS b, max(w) FILTER (src >= dst) AS lower, max(w) FILTER (src < dst) AS upper FROM graph WHERE w <> 0 GROUP BY 1, 2)),
    ends AS (SELECT src, dst, w FROM u UNION ALL SELECT dst, src, w FROM u WHERE src <> dst),
    deg2 AS (SELECT node, coalesce(sum(w), 0) + coalesce(sum(w) FILTER (src = dst), 0) AS d FROM nodes LEFT JOIN ends ON src = node GROUP BY 1),
    pick(batch_id, batch, used) AS (
      SELECT -1, []::INTEGER[], []::INTEGER[]
      UNION ALL
      SELECT batch_id + 1, batch, used || batch
      FROM (SELECT s.batch_id, s.used, [s.seed] || coalesce(list_slice(list(b.dst ORDER BY b.w DESC, b.dst) FILTER (b.dst IS NOT NULL), 1, greatest(2, CAST(trunc({base} - max(deg2.d) * {scale}::DOUBLE) AS INTEGER)) - 1), []) AS batch
            FROM (SELECT p.batch_id, p.used, arg_max(n.node, {{'d': n.d, 'n': -n.node}}) AS seed FROM pick p, deg2 n WHERE NOT list_contains(p.used, n.node) GROUP BY 1, 2) s
            JOIN deg2 ON deg2.node = s.seed LEFT JOIN ends b ON b.src = s.seed AND b.dst <> s.seed AND b.w > 0 AND NOT list_contains(s.used, b.dst) GROUP BY 1, 2, s.seed)),
    out AS (SELECT batch_id, unnest(range(len(batch))) AS pos, unnest(batch) AS node FROM pick WHERE batch_id >= 0)"""


def granger(maxlag: int = 2) -> str:
    """1 - the least p over lags 1 and 2. Cross products of (y, 1, own lags, cause's lags) are swept on the
    predictors, which leaves the sum of squared residuals at (y, y); F has closed forms for 1 and 2 degrees."""
    out = ["size AS (SELECT max(t) + 1 AS n FROM panel)"]
    for lag in range(1, maxlag + 1):
        own = " UNION ALL ".join(f"SELECT a.node AS src, y.node AS dst, y.t, {1 + k} AS v, o.value AS x FROM panel a JOIN panel y ON a.t = y.t AND a.node <> y.node JOIN panel o ON o.node = y.node AND o.t = y.t - {k} WHERE y.t >= {lag}" for k in range(1, lag + 1))
        cause = " UNION ALL ".join(f"SELECT a.node, y.node, y.t, {1 + lag + k}, o.value FROM panel a JOIN panel y ON a.t = y.t AND a.node <> y.node JOIN panel o ON o.node = a.node AND o.t = y.t - {k} WHERE y.t >= {lag}" for k in range(1, lag + 1))
        plain = f"SELECT a.node, y.node, y.t, v, CASE WHEN v = 0 THEN y.value ELSE 1 END FROM panel a JOIN panel y ON a.t = y.t AND a.node <> y.node, (VALUES (0), (1)) z(v) WHERE y.t >= {lag}"
        out.append(f"x{lag} AS ({own} UNION ALL {cause} UNION ALL {plain})")
        out.append(f"m{lag}_0 AS (SELECT src, dst, a.v AS i, b.v AS j, sum(a.x * b.x) AS w FROM x{lag} a JOIN x{lag} b USING (src, dst, t) GROUP BY 1, 2, 3, 4)")
        for step, k in enumerate(range(1, 2 * lag + 2)):
            of = f"m{lag}_{step}"
            out.append(f"""m{lag}_{step + 1} AS (SELECT x.src, x.dst, x.i, x.j, CASE WHEN x.i = {k} AND x.j = {k} THEN -1 / p.w WHEN x.i = {k} OR x.j = {k} THEN x.w / p.w ELSE x.w - r.w * c.w / p.w END AS w
              FROM {of} x JOIN {of} p ON p.src = x.src AND p.dst = x.dst AND p.i = {k} AND p.j = {k} JOIN {of} r ON r.src = x.src AND r.dst = x.dst AND r.i = x.i AND r.j = {k} JOIN {of} c ON c.src = x.src AND c.dst = x.dst AND c.i = {k} AND c.j = x.j)""")
        out.append(f"f{lag} AS (SELECT a.src, a.dst, n - {lag} - {2 * lag + 1} AS df, (a.w - b.w) / {lag} / (b.w / (n - {lag} - {2 * lag + 1})) AS f FROM m{lag}_{lag + 1} a JOIN m{lag}_{2 * lag + 1} b ON a.src = b.src AND a.dst = b.dst, size WHERE a.i = 0 AND a.j = 0 AND b.i = 0 AND b.j = 0)")
    return ", ".join(out) + """,
    one AS (SELECT src, dst, df, atan(sqrt(greatest(f, 0) / df)) AS a FROM f1),
    series AS (SELECT src, dst, any_value(df) AS df, any_value(a) AS a, sum(exp(l) * power(cos(a), CASE WHEN df % 2 = 0 THEN 2 * k ELSE 2 * k + 1 END)) AS s
      FROM (SELECT src, dst, df, a, k, sum(CASE WHEN k = 0 THEN 0 WHEN df % 2 = 0 THEN ln((2 * k - 1) / (2.0::DOUBLE * k)) ELSE ln(2 * k / (2.0::DOUBLE * k + 1)) END) OVER (PARTITION BY src, dst ORDER BY k) AS l FROM one, range(0, 2000) r(k) WHERE k <= CASE WHEN df % 2 = 0 THEN df // 2 - 1 ELSE (df - 3) // 2 END) GROUP BY 1, 2),
    p1 AS (SELECT src, dst, CASE WHEN df % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + sin(a) * s) END AS w FROM series),
    p2 AS (SELECT src, dst, 1 - power(1 + 2 * greatest(f, 0) / df, -df / 2.0::DOUBLE) AS w FROM f2),
    out AS (SELECT src, dst, greatest(p1.w, p2.w) AS w FROM p1 JOIN p2 USING (src, dst) UNION ALL SELECT node, node, 0.0 FROM nodes)"""
