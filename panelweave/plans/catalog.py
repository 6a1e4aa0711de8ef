"""Registered queries over the driver's tables, each with SQL for DuckDB where SQL can express it.

Names are ``family_operator``. Doubles are rounded to 6 digits (+ 0.0 against a negative zero). The
base is the ``nation_month`` panel; ``sim`` is its Pearson matrix, ``graph`` the top 5 per row of |sim|."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.frames import magnitude, series, transpose
from ..functions import adjacency, panels
from ..functions.normalize import NORMALIZERS
from ..operators import batchers, forecasting, fusion, generators, metrics, sparsifiers
from ..sources import datasets
from . import recursive
from .construct import MatrixConstruction, adjacency_from_generator, make_adjacency, make_hybrid_adjacency, top_k_adjacency

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Base:
    """Frames that several queries begin with; nothing is computed until a query needs it.

    The N x N matrices, which a query reads many times, are cached (in memory and on disk); the panel,
    which is as long as the input, is not."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def panel(self):
        return panels.nation_month(self.spark, self.dir)

    @cached_property
    def nodes(self):
        return self.sim.where("src = dst").select(F.col("src").alias("node"))

    @cached_property
    def sim(self):
        return generators.Pearson().generate(self.panel).cache()

    @cached_property
    def cos(self):
        return generators.cosine(series(self.panel)).cache()

    @cached_property
    def graph(self):
        return make_adjacency(self.sim, 0, "top-k-row", mask_params={"k_per_node": 5}).cache()

    @cached_property
    def hours(self):
        return panels.event_hour(self.spark, self.dir)


PANEL = """
sums AS (SELECT c_nationkey AS node, year(o_orderdate) * 12 + month(o_orderdate) AS m, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
panel AS (
  SELECT CAST(g.m - g.a AS INTEGER) AS t, CAST(n.node AS INTEGER) AS node, coalesce(s.v, 0.0) AS value
  FROM (SELECT DISTINCT node FROM sums) n CROSS JOIN (SELECT a, unnest(range(a, b + 1)) AS m FROM (SELECT min(m) AS a, max(m) AS b FROM sums)) g
  LEFT JOIN sums s ON s.node = n.node AND s.m = g.m),
nodes AS (SELECT DISTINCT node FROM panel)"""
SIM = PANEL + """,
sim AS (SELECT a.node AS src, b.node AS dst, CASE WHEN a.node = b.node THEN 1.0 ELSE corr(a.value, b.value) END AS w FROM panel a JOIN panel b USING (t) GROUP BY 1, 2)"""
COS = """,
norm AS (SELECT node, sqrt(sum(value * value)) + 1e-8 AS q FROM panel GROUP BY 1),
cosine AS (SELECT a.node AS src, b.node AS dst, sum(a.value / x.q * (b.value / y.q)) AS w FROM panel a JOIN panel b USING (t) JOIN norm x ON x.node = a.node JOIN norm y ON y.node = b.node GROUP BY 1, 2)"""
GRAPH = SIM + """,
ranked AS (SELECT src, dst, abs(w) AS w, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) AS r FROM sim WHERE src <> dst),
graph AS (SELECT src, dst, w FROM ranked WHERE r <= 5),
deg AS (SELECT node, coalesce(sum(w), 0) AS deg FROM nodes LEFT JOIN graph ON src = node GROUP BY 1)"""
HOURS = """
sums AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, sum(value) AS v FROM events GROUP BY 1, 2),
kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS node FROM (SELECT DISTINCT event_type FROM sums)),
panel AS (
  SELECT CAST(g.h - g.a AS INTEGER) AS t, k.node, coalesce(s.v, 0.0) AS value
  FROM kinds k CROSS JOIN (SELECT a, unnest(range(a, b + 1)) AS h FROM (SELECT min(h) AS a, max(h) AS b FROM sums)) g LEFT JOIN sums s ON s.event_type = k.event_type AND s.h = g.h),
nodes AS (SELECT DISTINCT node FROM panel)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, make: Callable[[Base], DataFrame], sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(make(Base(spark, sf_dir)), digits)
    if sql:
        ORACLES[name] = sql


def r(expression: str, name: str = "", digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


W = "src, dst, " + r("w")


def edges_sql(base: str, body: str) -> str:
    return f"WITH {base} SELECT {W} FROM ({body})"


# ------------------------------------------------------------------ sources and panels

add("panel_nation_month", lambda b: b.panel, f"WITH {PANEL} SELECT t, node, {r('value')} FROM panel")
add("panel_event_hour", lambda b: b.hours, f"WITH {HOURS} SELECT t, node, {r('value')} FROM panel")
add(
    "panel_user_day_top",
    lambda b: make_adjacency(generators.pearson_top(panels.user_day(b.spark, b.dir), 3).cache(), 0, "top-k-row", mask_params={"k_per_node": 3}),
    """WITH sums AS (SELECT user_id AS node, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, sum(value) AS v FROM events GROUP BY 1, 2),
    panel AS (SELECT n.node, g.d AS t, coalesce(v, 0.0) AS value FROM (SELECT DISTINCT node FROM sums) n CROSS JOIN (SELECT unnest(range(a, b + 1)) AS d FROM (SELECT min(d) AS a, max(d) AS b FROM sums)) g LEFT JOIN sums s ON s.node = n.node AND s.d = g.d),
    m AS (SELECT node, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM panel GROUP BY 1),
    c AS (SELECT a.node AS src, b.node AS dst, corr(a.value, b.value) AS w FROM panel a JOIN panel b ON a.t = b.t AND a.node <> b.node JOIN m x ON x.node = a.node AND x.sd > 0 JOIN m y ON y.node = b.node AND y.sd > 0 GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) AS r FROM c)
    SELECT CAST(src AS INTEGER) AS src, CAST(dst AS INTEGER) AS dst, """ + r("abs(w)", "w") + " FROM k WHERE r <= 3",
)
add(
    "source_sinusoidal",
    lambda b: datasets.sinusoidal_panel(b.spark, 3, 200, 2, noise_level=0.0),
    f"""WITH g AS (SELECT CAST(t AS INTEGER) AS t, CAST(n AS INTEGER) AS node, CAST(f AS INTEGER) AS feature, t * 10.0::DOUBLE / 199 AS x FROM range(200) a(t), range(3) b(n), range(2) c(f))
    SELECT t, node, feature, {r("CASE WHEN feature = 1 THEN 0 WHEN node = 0 THEN sin(x) WHEN node = 1 THEN sin(x - 0.5) ELSE sin(x) * sin(x) END", "value")} FROM g""",
)
add("source_gaussian", lambda b: datasets.gaussian_panel(b.spark))
add("panel_train_slice", lambda b: panels.train_slice(b.panel, 0.7), f"WITH {PANEL} SELECT t, node, {r('value')} FROM panel WHERE t < CAST(floor((SELECT max(t) + 1 FROM panel) * 0.7::DOUBLE) AS INTEGER)")
add("panel_statistics", lambda b: metrics.panel_statistics(b.panel), f"WITH {PANEL} SELECT {r('avg(value)', 'mean', 3)}, {r('stddev_pop(value)', 'std', 3)}, {r('min(value)', 'min', 3)}, {r('max(value)', 'max', 3)}, {r('quantile_cont(value, 0.001)', 'p0_1', 3)}, {r('quantile_cont(value, 0.999)', 'p99_9', 3)} FROM panel", 3)
add("panel_zero_variance", lambda b: panels.zero_variance_nodes(b.hours, 60.0), f"WITH {HOURS} SELECT node, {r('stddev_pop(value)', 'std')} FROM panel GROUP BY 1 HAVING stddev_pop(value) <= 60")
add("panel_is_dense", lambda b: panels.is_dense(b.panel), f"WITH {PANEL} SELECT count(*) = count(DISTINCT t) * count(DISTINCT node) AS dense FROM panel")
add("node_series", lambda b: metrics.node_series(b.panel, 3, 10, 40), f"WITH {PANEL} SELECT t, {r('value')} FROM panel WHERE node = 3 AND t >= 10 AND t < 40")

# ------------------------------------------------------------------ generators

add("gen_pearson", lambda b: b.sim, f"WITH {SIM} SELECT {W} FROM sim")
add("gen_cosine", lambda b: b.cos, f"WITH {PANEL}{COS} SELECT {W} FROM cosine")
add(
    "gen_cosine_embeddings_top",
    lambda b: make_adjacency(generators.cosine_top(panels.embedding_vectors(b.spark, b.dir), 2).cache(), 0, "top-k-row", mask_params={"k_per_node": 2}),
    f"""WITH v AS (SELECT CAST(vec_id AS INTEGER) AS node, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    q AS (SELECT node, sqrt(sum(x * x)) + 1e-8 AS q FROM v GROUP BY 1), u AS (SELECT node, i, x / q AS x FROM v JOIN q USING (node)),
    c AS (SELECT a.node AS src, b.node AS dst, sum(a.x * b.x) AS w FROM u a JOIN u b USING (i) WHERE a.node <> b.node GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) AS r FROM c) SELECT src, dst, {r("abs(w)", "w")} FROM k WHERE r <= 2""",
)
MI = f"""WITH {PANEL},
z AS (SELECT a.node AS src, b.node AS dst, a.t, a.value AS x, b.value AS y FROM panel a JOIN panel b USING (t) WHERE a.node < b.node),
pr AS (SELECT u.src, u.dst, u.t, abs(u.x - w.x) AS dx, abs(u.y - w.y) AS dy FROM z u JOIN z w USING (src, dst)),
e AS (SELECT src, dst, t, d AS eps FROM (SELECT src, dst, t, greatest(dx, dy) AS d, row_number() OVER (PARTITION BY src, dst, t ORDER BY greatest(dx, dy)) AS r FROM pr) WHERE r = 4),
c AS (SELECT src, dst, t, greatest(count(*) FILTER (dx < eps) - 1, 0) AS nx, greatest(count(*) FILTER (dy < eps) - 1, 0) AS ny FROM pr JOIN e USING (src, dst, t) GROUP BY 1, 2, 3),
h AS (SELECT n, coalesce(sum(1.0::DOUBLE / nullif(n, 0)) OVER (ORDER BY n), 0) AS h FROM range(0, 2000) x(n)),
mi AS (SELECT src, dst, (SELECT h FROM h WHERE n = 2) + (SELECT h FROM h WHERE n = (SELECT count(DISTINCT t) - 1 FROM panel)) - avg(p.h + q.h) AS w FROM c JOIN h p ON p.n = nx JOIN h q ON q.n = ny GROUP BY 1, 2),
every AS (SELECT src, dst, w FROM mi UNION ALL SELECT dst, src, w FROM mi UNION ALL SELECT node, node, greatest(0, (SELECT max(w) FROM mi)) FROM nodes)
SELECT {W} FROM every"""
add("gen_mi_ksg", lambda b: generators.MutualInformation(3).generate(b.panel), MI)
add("gen_mi_standard", lambda b: generators.MutualInformation(3, backend="standard").generate(b.hours))
add("gen_partial_corr", lambda b: generators.PartialCorrelation().generate(b.hours), f"WITH {HOURS}, {recursive.partial_correlation(5)} SELECT {W} FROM out")
SCALED = "/ 1e6 AS value"
add("gen_dtw", lambda b: generators.DTW(window=8).generate(b.panel.withColumn("value", F.col("value") / 1e6)), f"WITH RECURSIVE {PANEL.replace('AS value', SCALED)}, {recursive.dtw(8)} SELECT {W} FROM out")
add("gen_dtw_pruned", lambda b: generators.DTW(window=8, pruning_threshold=1.0).generate(b.panel.withColumn("value", F.col("value") / 1e6)), f"WITH RECURSIVE {PANEL.replace('AS value', SCALED)}, {recursive.dtw(8, 1.0)} SELECT {W} FROM out")
add("gen_dtw_envelope", lambda b: generators.envelopes(b.panel, 8), f"WITH {PANEL} SELECT t, node, {r('max(value) OVER f', 'upper')}, {r('min(value) OVER f', 'lower')} FROM panel WINDOW f AS (PARTITION BY node ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)")
add(
    "gen_dtw_lb_keogh",
    lambda b: generators.lb_keogh(b.panel, 8),
    f"""WITH {PANEL}, env AS (SELECT t, node, max(value) OVER f AS upper, min(value) OVER f AS lower FROM panel WINDOW f AS (PARTITION BY node ORDER BY t ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
    d AS (SELECT p.node AS src, e.node AS dst, CASE WHEN value > upper THEN value - upper WHEN value < lower THEN lower - value ELSE 0 END AS o FROM panel p JOIN env e ON p.t = e.t AND p.node <> e.node)
    SELECT src, dst, {r("sqrt(sum(o * o))", "w", 3)} FROM d GROUP BY 1, 2""",
    3,
)
add("gen_granger", lambda b: generators.Granger(2).generate(b.hours), f"WITH {HOURS}, {recursive.granger()} SELECT {W} FROM out")
add("gen_embedding_cosine", lambda b: generators.CosineOfEmbeddings().generate(b.panel))
add("gen_study_correlation", lambda b: generators.Pearson().generate(b.panel.where("node < 50")), f"WITH {SIM} SELECT {W} FROM sim WHERE src < 50 AND dst < 50")

# ------------------------------------------------------------------ element-wise, checks, transforms

add("adj_add_self_loops", lambda b: adjacency.add_self_loops(b.graph, b.nodes, 2.0), edges_sql(GRAPH, "SELECT * FROM graph WHERE src <> dst UNION ALL SELECT node, node, 2.0 FROM nodes"))
add("adj_remove_self_loops", lambda b: adjacency.remove_self_loops(b.sim), edges_sql(SIM, "SELECT * FROM sim WHERE src <> dst"))
for how, w in (("avg", "(coalesce(a.w, 0) + coalesce(b.w, 0)) / 2"), ("max", "greatest(coalesce(a.w, 0), coalesce(b.w, 0))"), ("min", "least(coalesce(a.w, 0), coalesce(b.w, 0))")):
    add(f"adj_symmetrize_{how}", lambda b, how=how: adjacency.symmetrize(b.graph, how), edges_sql(GRAPH, f"SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, {w} AS w FROM graph a FULL JOIN graph b ON a.src = b.dst AND a.dst = b.src"))
SYMMETRIC = ", sym AS (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, greatest(coalesce(a.w, 0), coalesce(b.w, 0)) AS w FROM graph a FULL JOIN graph b ON a.src = b.dst AND a.dst = b.src)"
add("adj_submatrix", lambda b: adjacency.submatrix(b.sim, b.nodes.where("node < 5"), b.nodes.where("node >= 20")), edges_sql(SIM, "SELECT * FROM sim WHERE src < 5 AND dst >= 20"))
add("adj_upper_triangle", lambda b: adjacency.upper_triangle(b.sim), edges_sql(SIM, "SELECT * FROM sim WHERE src < dst"))
add("adj_abs", lambda b: magnitude(b.sim), edges_sql(SIM, "SELECT src, dst, abs(w) AS w FROM sim"))
add("validate_adjacency", lambda b: adjacency.validate(b.sim, b.nodes), f"WITH {SIM} SELECT NOT any_bad AS ok, CASE WHEN any_bad THEN 'contains negative weights' ELSE 'valid' END AS message FROM (SELECT bool_or(w < 0) AS any_bad FROM sim)")
add("adj_original", lambda b: adjacency.transform(b.graph, b.nodes, "original"), edges_sql(GRAPH, "SELECT * FROM graph"))
add("adj_identity", lambda b: adjacency.transform(b.graph, b.nodes, "identity"), edges_sql(PANEL, "SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nodes"))
NORMLAP = "SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, -w / sqrt(p.deg * q.deg) AS w FROM {g} JOIN {d} p ON p.node = src JOIN {d} q ON q.node = dst WHERE p.deg > 0 AND q.deg > 0 UNION ALL SELECT node, node, 1.0 FROM nodes) GROUP BY 1, 2"
SYM_DEG = SYMMETRIC + ", sdeg AS (SELECT node, coalesce(sum(w), 0) AS deg FROM nodes LEFT JOIN sym ON src = node GROUP BY 1)"
add("adj_normlap", lambda b: adjacency.normalized_laplacian(adjacency.symmetrize(b.graph, "max"), b.nodes), edges_sql(GRAPH + SYM_DEG, NORMLAP.format(g="sym", d="sdeg")))
add("adj_scalap", lambda b: adjacency.transform(b.graph, b.nodes, "scalap"), edges_sql(GRAPH + SYM_DEG, f"SELECT src, dst, w - (src = dst)::INTEGER AS w FROM ({NORMLAP.format(g='sym', d='sdeg')})"))
HAT = ", hat AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM graph UNION ALL SELECT node, node, 1.0 FROM nodes) GROUP BY 1, 2), hdeg AS (SELECT src AS node, sum(w) AS deg FROM hat GROUP BY 1)"
add("adj_symnadj", lambda b: adjacency.transform(b.graph, b.nodes, "symnadj"), edges_sql(GRAPH + HAT, "SELECT dst AS src, src AS dst, w / deg AS w FROM hat JOIN hdeg ON node = src"))
add("adj_symnadj_documented", lambda b: adjacency.message_passing(b.graph, b.nodes, "documented"), edges_sql(GRAPH + HAT, "SELECT src, dst, w / sqrt(p.deg * q.deg) AS w FROM hat JOIN hdeg p ON p.node = src JOIN hdeg q ON q.node = dst"))
add("adj_transition", lambda b: adjacency.transform(b.graph, b.nodes, "transition"), edges_sql(GRAPH, "SELECT dst AS src, src AS dst, w / deg AS w FROM graph JOIN deg ON node = src"))
add("adj_doubletransition", lambda b: adjacency.transform(b.graph, b.nodes, "doubletransition"), f"WITH {GRAPH}, ideg AS (SELECT dst AS node, sum(w) AS deg FROM graph GROUP BY 1) SELECT {W}, CAST(dir AS INTEGER) AS dir FROM (SELECT dst AS src, src AS dst, w / deg AS w, 0 AS dir FROM graph JOIN deg ON node = src UNION ALL SELECT src, dst, w / deg, 1 FROM graph JOIN ideg ON node = dst)")
add("adj_degree", lambda b: adjacency.degree_matrix(b.graph, b.nodes), edges_sql(GRAPH, "SELECT node AS src, node AS dst, deg AS w FROM deg"))
add("adj_inverse_degree", lambda b: adjacency.inverse_degree_matrix(b.graph, b.nodes, -0.5), edges_sql(GRAPH, "SELECT node AS src, node AS dst, power(deg + 1e-10, -0.5) AS w FROM deg"))

# ------------------------------------------------------------------ masks


def mask(name: str, s: Callable[[Base], sparsifiers.Sparsifier], k: int, sql: str | None = None) -> None:
    add(name, lambda b: s(b).mask(b.sim, b.nodes, k).select("src", "dst"), sql)


TOP = "SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) AS r FROM sim WHERE src <> dst) WHERE r <= {k}"
mask("mask_top_k_row", lambda b: sparsifiers.TopKRow(3), 0, f"WITH {SIM} {TOP.format(k=3)}")
mask("mask_top_k_row_budget", lambda b: sparsifiers.TopKRow(), 100, f"WITH {SIM} {TOP.format(k=4)}")
mask("mask_top_k_global", lambda b: sparsifiers.GlobalTopE(), 60, f"WITH {SIM} SELECT src, dst FROM (SELECT src, dst FROM sim WHERE src <> dst ORDER BY abs(round(w, 12)) DESC, src DESC, dst DESC LIMIT 60)")
UNDIRECTED = "SELECT src, dst FROM t UNION ALL SELECT dst, src FROM t"
mask("mask_top_k_global_undirected", lambda b: sparsifiers.GlobalTopE(directed=False), 30, f"WITH {SIM}, t AS (SELECT src, dst FROM sim WHERE src < dst ORDER BY abs(w) DESC, src DESC, dst DESC LIMIT 30) {UNDIRECTED}")
mask("mask_greedy_degree", lambda b: sparsifiers.DegreeGreedy(directed=False), 40, f"WITH RECURSIVE {SIM}, {recursive.greedy_degree(40, 0.1)} SELECT src, dst FROM out")
mask(
    "mask_threshold", lambda b: sparsifiers.ThresholdBudget(directed=False), 50,
    f"""WITH RECURSIVE {SIM}, u AS (SELECT src, dst, abs(w) AS w FROM sim WHERE src < dst),
    b(lo, hi, mid, n, i) AS (SELECT 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, (SELECT count(*) FROM u WHERE w > 0.5), 1
      UNION ALL SELECT l, h, (l + h) / 2, (SELECT count(*) FROM u WHERE w > (l + h) / 2), i + 1 FROM (SELECT CASE WHEN n > 50 THEN mid ELSE lo END AS l, CASE WHEN n > 50 THEN hi ELSE mid END AS h, i, n FROM b WHERE abs(n - 50) > 1) WHERE h - l >= 1e-6),
    t AS (SELECT src, dst FROM u WHERE w > (SELECT mid FROM b ORDER BY i DESC LIMIT 1)) {UNDIRECTED}""",
)
mask("mask_knn_budget", lambda b: sparsifiers.KnnWithBudget(6), 80, f"WITH {SIM}, l AS ({TOP.format(k=6)}), c AS (SELECT src, dst, abs(round(w, 12)) AS w FROM sim JOIN l USING (src, dst)) SELECT src, dst FROM c WHERE w >= (SELECT min(w) FROM (SELECT w FROM c ORDER BY w DESC LIMIT 80))")
mask("mask_knn_budget_undirected", lambda b: sparsifiers.KnnWithBudget(6, directed=False), 40, f"WITH {SIM}, l AS ({TOP.format(k=6)}), c AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM l), t AS (SELECT src, dst FROM sim JOIN c USING (src, dst) ORDER BY abs(w) DESC, src DESC, dst DESC LIMIT 40) {UNDIRECTED}")
B0 = "b0 AS (SELECT src, dst, CASE WHEN src = dst THEN 'Infinity'::DOUBLE ELSE abs(round(w, 12)) END AS w FROM sim)"
CLOSURE = ", ".join([B0, *[f"b{i} AS (SELECT x.src, y.dst, max(least(x.w, y.w)) AS w FROM b{i - 1} x JOIN b{i - 1} y ON x.dst = y.src GROUP BY 1, 2)" for i in range(1, 6)]])
TREE = f"{CLOSURE}, t AS (SELECT b0.src, b0.dst FROM b0 JOIN b5 USING (src, dst) WHERE src < dst AND b0.w >= b5.w)"
mask("mask_mst", lambda b: sparsifiers.MST(), 0, f"WITH {SIM}, {TREE} {UNDIRECTED}")
mask("mask_mst_hybrid", lambda b: sparsifiers.MST(True, 2), 0, f"WITH {SIM}, {TREE}, k AS ({TOP.format(k=2)}) SELECT src, dst FROM t UNION SELECT dst, src FROM t UNION SELECT src, dst FROM k UNION SELECT dst, src FROM k")
SCORE = ", f AS (SELECT src AS node, 1 / (sum(abs(w)) + 1e-12) AS f FROM sim WHERE src <> dst GROUP BY 1), s AS (SELECT src, dst, abs(w) AS w, abs(w) * (p.f + q.f) AS score FROM sim JOIN f p ON p.node = src JOIN f q ON q.node = dst WHERE src < dst)"
mask("mask_spectral_proxy", lambda b: sparsifiers.SpectralProxy(ensure_connected=False), 40, f"WITH {SIM}{SCORE}, t AS (SELECT src, dst FROM s ORDER BY score DESC, w DESC, src, dst LIMIT 40) {UNDIRECTED}")
mask(
    "mask_spectral_proxy_connected", lambda b: sparsifiers.SpectralProxy(), 40,
    f"WITH {SIM}{SCORE}, {TREE.replace('t AS (SELECT b0', 'tree AS (SELECT b0')}, t AS (SELECT s.src, s.dst FROM s LEFT JOIN tree USING (src, dst) ORDER BY (tree.src IS NOT NULL) DESC, score DESC LIMIT 40) {UNDIRECTED}",
)
mask("mask_resistance_sampling", lambda b: sparsifiers.ResistanceSampling(seed=1), 60)
add("resistance_reweighted", lambda b: sparsifiers.ResistanceSampling(seed=1).sample(b.sim, b.nodes, 60))
mask("mask_dhondt", lambda b: sparsifiers.DHondt(), 60, f"WITH RECURSIVE {SIM}, {recursive.dhondt(60, True)} SELECT src, dst FROM out")
mask("mask_dhondt_top_edge", lambda b: sparsifiers.DHondt("top_edge"), 60, f"WITH RECURSIVE {SIM}, {recursive.dhondt(60, False)} SELECT src, dst FROM out")
mask("mask_mutual_knn", lambda b: sparsifiers.MutualKnn(4), 0, f"WITH {SIM}, l AS ({TOP.format(k=4)}) SELECT a.src, a.dst FROM l a JOIN l b ON a.src = b.dst AND a.dst = b.src")
mask("mask_pmfg", lambda b: sparsifiers.PMFG(), 0)
mask("mask_neighbour_k", lambda b: sparsifiers.NeighbourK(transpose(b.graph)), 0, f"WITH {GRAPH}, k AS (SELECT dst AS src, count(*) AS k FROM graph GROUP BY 1) SELECT src, dst FROM ranked JOIN k USING (src) WHERE r <= k")
add("mask_apply_signed", lambda b: sparsifiers.TopKRow(3).apply(b.sim, 0), edges_sql(SIM, f"SELECT src, dst, w FROM sim JOIN ({TOP.format(k=3)}) USING (src, dst)"))

# ------------------------------------------------------------------ normalizers and construction

SET = "abs(w) >= 1e-6"
NORM_SQL = {
    "row-l1": "SELECT src, dst, w / sum(abs(w)) OVER (PARTITION BY src) AS w FROM graph",
    "row-softmax": "SELECT src, dst, exp(w) / sum(exp(w)) OVER (PARTITION BY src) AS w FROM graph",
    "softmax": "SELECT src, dst, exp(w) / sum(exp(w)) OVER () AS w FROM graph",
    "row-minmax": "SELECT src, dst, CASE WHEN max(w) OVER p - min(w) OVER p <= 1e-6 THEN w ELSE (w - min(w) OVER p) / nullif(max(w) OVER p - min(w) OVER p, 0) END AS w FROM graph WINDOW p AS (PARTITION BY src)",
    "minmax": "SELECT src, dst, (w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ()) AS w FROM graph",
    "make-1": "SELECT src, dst, 1.0::DOUBLE AS w FROM graph",
}
for key, body in NORM_SQL.items():
    add(f"norm_{key.replace('-', '_')}", lambda b, key=key: NORMALIZERS[key]().normalize(b.graph), edges_sql(GRAPH, body))
L1 = "SELECT src, dst, w / sum(abs(w)) OVER (PARTITION BY src) AS w"
add("flagship_adjacency", lambda b: adjacency_from_generator(generators.Pearson(), b.panel, 75, norm_method="row-l1"), edges_sql(SIM, f"{L1} FROM (SELECT src, dst, abs(w) AS w FROM sim JOIN ({TOP.format(k=3)}) USING (src, dst))"))
add("construct_fill_diagonal", lambda b: make_adjacency(b.sim, 100, "top-k-row", "row-l1", fill_diag=True), edges_sql(SIM, f"{L1} FROM (SELECT src, dst, abs(w) AS w FROM sim JOIN ({TOP.format(k=3)}) USING (src, dst) UNION ALL SELECT node, node, 1.0 FROM nodes)"))
add("construct_two_masks", lambda b: MatrixConstruction([sparsifiers.TopKRow(6), sparsifiers.MutualKnn(8)], [NORMALIZERS["row-minmax"](), NORMALIZERS["row-l1"]()]).run(b.sim, 0), edges_sql(SIM, f"""WITH l AS ({TOP.format(k=8)}), c AS (SELECT src, dst, abs(w) AS w FROM sim JOIN ({TOP.format(k=6)}) USING (src, dst) WHERE (src, dst) IN (SELECT (a.src, a.dst) FROM l a JOIN l b ON a.src = b.dst AND a.dst = b.src)),
    m AS (SELECT src, dst, CASE WHEN max(w) OVER p - min(w) OVER p <= 1e-6 THEN w ELSE (w - min(w) OVER p) / nullif(max(w) OVER p - min(w) OVER p, 0) END AS w FROM c WINDOW p AS (PARTITION BY src)) {L1} FROM m"""))
add("construct_no_mask", lambda b: MatrixConstruction(None, NORMALIZERS["row-l1"]()).run(b.sim, 0), edges_sql(SIM, f"{L1} FROM (SELECT src, dst, abs(w) AS w FROM sim)"))
add("construct_hybrid", lambda b: make_hybrid_adjacency([b.sim, b.cos], 100, "max", norm_method="softmax"), f"WITH {SIM}{COS}, m AS (SELECT src, dst, greatest(sim.w, cosine.w) AS w FROM sim JOIN cosine USING (src, dst)), k AS (SELECT src, dst, abs(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, dst DESC) AS r FROM m WHERE src <> dst) WHERE r <= 4) SELECT src, dst, {r('exp(w) / sum(exp(w)) OVER ()', 'w')} FROM k")
add("construct_top_k", lambda b: top_k_adjacency(b.sim, 4, "make-1"), edges_sql(SIM, f"SELECT src, dst, 1.0::DOUBLE AS w FROM ({TOP.format(k=4)})"))

# ------------------------------------------------------------------ fusion

VIEWS = SIM + COS
add("fuse_weighted_average", lambda b: fusion.WeightedAverage([3, 1]).fuse([b.sim, b.cos], b.nodes), edges_sql(VIEWS, "SELECT src, dst, sim.w * 0.75 + cosine.w * 0.25 AS w FROM sim JOIN cosine USING (src, dst)"))
for key, op in (("max", "greatest"), ("min", "least")):
    add(f"fuse_{key}", lambda b, key=key: fusion.FUSERS[key]().fuse([b.graph, b.cos], b.nodes), edges_sql(GRAPH + COS, f"SELECT cosine.src, cosine.dst, {op}(coalesce(graph.w, 0), cosine.w) AS w FROM cosine LEFT JOIN graph ON graph.src = cosine.src AND graph.dst = cosine.dst"))
add(
    "fuse_rank_average", lambda b: fusion.RankAverage().fuse([rounded(b.sim, 9), rounded(b.cos, 9)], b.nodes),
    f"WITH {VIEWS}, v AS (SELECT 0 AS view, src, dst, round(w, 9) AS w FROM sim UNION ALL SELECT 1, src, dst, round(w, 9) FROM cosine), k AS (SELECT src, dst, row_number() OVER (PARTITION BY view ORDER BY abs(w), src, dst) - 1 AS r FROM v), s AS (SELECT src, dst, sum(r) AS w FROM k GROUP BY 1, 2) SELECT src, dst, {r('(w - min(w) OVER ()) / (max(w) OVER () - min(w) OVER ())', 'w')} FROM s",
)


def _snf_sql(rounds: int) -> str:
    out, norm = [VIEWS], "SELECT src, dst, w / coalesce(nullif(sum(w) OVER (PARTITION BY src), 0), 1) AS w FROM {x}"
    for i, view in enumerate(("sim", "cosine")):
        out += [f"w{i} AS (SELECT src, dst, abs(w) AS w FROM {view} WHERE src <> dst)", f"p{i}_0 AS ({norm.format(x=f'w{i}')})"]
        out += [f"n{i} AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) AS r FROM w{i}) WHERE r <= 5)"]
        out += [f"y{i} AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM n{i} UNION ALL SELECT dst, src, w FROM n{i}) GROUP BY 1, 2)", f"s{i} AS ({norm.format(x=f'y{i}')})"]
    for k in range(rounds):
        for i in (0, 1):
            out += [f"a{i}_{k} AS (SELECT s.src, p.dst, sum(s.w * p.w) AS w FROM s{i} s JOIN p{1 - i}_{k} p ON s.dst = p.src GROUP BY 1, 2)"]
            out += [f"c{i}_{k} AS (SELECT a.src, s.src AS dst, sum(a.w * s.w) AS w FROM a{i}_{k} a JOIN s{i} s ON a.dst = s.dst GROUP BY 1, 2)", f"p{i}_{k + 1} AS ({norm.format(x=f'c{i}_{k}')})"]
    out += [f"m AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM p0_{rounds} UNION ALL SELECT * FROM p1_{rounds}) GROUP BY 1, 2)"]
    return f"WITH {', '.join(out)} SELECT src, dst, {r('sum(w) / 2', 'w')} FROM (SELECT * FROM m UNION ALL SELECT dst, src, w FROM m) GROUP BY 1, 2"


add("fuse_snf", lambda b: fusion.SNFDiffusion().fuse([b.sim, b.cos], b.nodes), _snf_sql(20))
add("fuse_snf_distributed", lambda b: fusion.SNFDiffusion(method="distributed").fuse([b.sim, b.cos], b.nodes), _snf_sql(20))
ATTENTION = fusion.Attention([[1.0, -0.5], [0.25, 0.75]], [0.1, -0.2], [[0.5, 1.0], [-1.0, 0.5]], [0.0, 0.3])
add(
    "fuse_attention", lambda b: ATTENTION.fuse([b.sim, b.cos], b.nodes),
    f"""WITH {VIEWS}, x AS (SELECT src, dst, sim.w AS a, cosine.w AS b FROM sim JOIN cosine USING (src, dst)),
    h AS (SELECT *, greatest(0.1 + a - 0.5 * b, 0) AS h0, greatest(-0.2 + 0.25 * a + 0.75 * b, 0) AS h1 FROM x),
    z AS (SELECT *, exp(0.5 * h0 + h1) AS e0, exp(0.3 - h0 + 0.5 * h1) AS e1 FROM h) SELECT src, dst, {r("(a * e0 + b * e1) / (e0 + e1)", "w")} FROM z""",
)

# ------------------------------------------------------------------ batchers

BATCH = "SELECT CAST(batch_id AS INTEGER) AS batch_id, CAST(pos AS INTEGER) AS pos, CAST(node AS INTEGER) AS node FROM out"
add("batch_k_hop", lambda b: batchers.KHop(1, 6).batch(b.graph, b.nodes), f"WITH RECURSIVE {GRAPH}, {recursive.k_hop(6)} {BATCH}")
LINKS = ", links AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph)"
add("batch_hops", lambda b: batchers.hops(b.graph, b.nodes, 2), f"WITH {GRAPH}{LINKS}, h AS (SELECT node AS seed, node, 0 AS hop FROM nodes UNION ALL SELECT src, dst, 1 FROM links UNION ALL SELECT a.src, b.dst, 2 FROM links a JOIN links b ON a.dst = b.src) SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM h GROUP BY 1, 2")
for key, make in {
    "greedy_cluster": lambda: batchers.GreedyCluster(6), "louvain": batchers.Louvain, "complete_linkage": lambda: batchers.CompleteLinkage(4), "spectral": lambda: batchers.Spectral(4),
    "balanced": lambda: batchers.BalancedPartition(4), "degree_aware": lambda: batchers.DegreeAware(6, 0.1), "greedy_modularity": batchers.GreedyModularity,
}.items():
    steps = {"greedy_cluster": recursive.greedy_cluster(6), "degree_aware": recursive.degree_aware(6, 0.1)}.get(key)
    add(f"batch_{key}", lambda b, make=make: make().batch(b.graph, b.nodes), f"WITH RECURSIVE {GRAPH}, {steps} {BATCH}" if steps else None)
SEEDS = f"{GRAPH}{LINKS}, ends AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM graph), dg AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM ends UNION ALL SELECT b FROM ends) GROUP BY 1), seeds AS (SELECT node, CAST(row_number() OVER (ORDER BY coalesce(d, 0) DESC, node DESC) - 1 AS INTEGER) AS batch_id FROM nodes LEFT JOIN dg USING (node)), few AS (SELECT * FROM seeds WHERE batch_id < greatest(1, CAST(floor((SELECT count(*) FROM nodes) * 0.2::DOUBLE) AS INTEGER))), inside AS (SELECT batch_id, node FROM few UNION SELECT batch_id, dst FROM few JOIN links ON src = node)"
add("batch_overlapping", lambda b: batchers.Overlapping(0.2, 1).batch(b.graph, b.nodes), f"WITH {SEEDS}, every AS (SELECT * FROM inside UNION ALL SELECT (SELECT count(*) FROM few), node FROM nodes WHERE node NOT IN (SELECT node FROM inside)) SELECT CAST(batch_id AS INTEGER) AS batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY node) - 1 AS INTEGER) AS pos, node FROM every")
add("batch_fixed", lambda b: batchers.FixedSize(4).batch(b.graph, b.nodes), f"WITH {PANEL} SELECT CAST(node // 4 AS INTEGER) AS batch_id, CAST(node % 4 AS INTEGER) AS pos, node FROM nodes")
add("batch_summary", lambda b: batchers.summary(batchers.FixedSize(4).batch(b.graph, b.nodes)), f"WITH {PANEL}, s AS (SELECT node // 4 AS b, count(*) AS n FROM nodes GROUP BY 1) SELECT count(*) AS n_batches, {r('avg(n)', 'avg_size')}, max(n) AS max_size, min(n) AS min_size FROM s")
add("batch_json_round_trip", lambda b: batchers.from_json(batchers.as_json(batchers.FixedSize(4).batch(b.graph, b.nodes))), f"WITH {PANEL} SELECT CAST(node // 4 AS INTEGER) AS batch_id, CAST(node % 4 AS INTEGER) AS pos, node FROM nodes")
add("batch_inline", lambda b: batchers.from_inline(b.spark.createDataFrame([("0,1|2;3,4|5",)], "text string")), "SELECT * FROM (VALUES (0, 0, 0, 0), (0, 0, 1, 1), (0, 1, 0, 2), (1, 0, 0, 3), (1, 0, 1, 4), (1, 1, 0, 5)) v(set_id, batch_id, pos, node)")
add(
    "validate_batches", lambda b: batchers.validate_batches(b.sim, batchers.FixedSize(5).batch(b.sim, b.nodes)),
    f"WITH {SIM}, v AS (SELECT (SELECT avg(abs(w)) FROM sim WHERE src < dst AND src // 5 = dst // 5) AS intra, (SELECT avg(abs(w)) FROM sim WHERE src // 5 <> dst // 5) AS inter) SELECT {r('intra')}, {r('inter')}, {r('intra / inter', 'ratio')}, intra > inter AS valid FROM v",
)

# ------------------------------------------------------------------ metrics and plot data

DEG = f"{GRAPH}, bin AS (SELECT src, dst FROM graph WHERE w > 1e-6), dd AS (SELECT node, (SELECT count(*) FROM bin WHERE dst = node) AS d_in, (SELECT count(*) FROM bin WHERE src = node) AS d_out FROM nodes), d AS (SELECT *, d_in + d_out AS deg FROM dd)"
add("metrics_degree", lambda b: metrics.degree_distribution(b.graph, b.nodes), f"WITH {DEG}, modes AS (SELECT deg FROM d GROUP BY 1 ORDER BY count(*) DESC, deg LIMIT 1) SELECT min(deg) AS min_degree, max(deg) AS max_degree, {r('avg(deg)', 'mean_degree')}, {r('quantile_cont(deg, 0.5)', 'median_degree')}, (SELECT deg FROM modes) AS mode_degree, {r('stddev_pop(deg)', 'std_degree')}, {r('quantile_cont(deg, 0.25)', 'q1_degree')}, {r('quantile_cont(deg, 0.75)', 'q3_degree')}, {r('avg(d_in)', 'mean_in_degree')}, {r('avg(d_out)', 'mean_out_degree')} FROM d")
add("metrics_edges", lambda b: metrics.edge_statistics(b.graph, b.nodes), f"WITH {DEG}, c AS (SELECT (SELECT count(*) FROM bin) AS e, (SELECT count(*) FROM nodes) AS n) SELECT n, e AS edges, {r('e / (n * (n - 1.0::DOUBLE))', 'density')}, {r('1 - e / (n * n * 1.0::DOUBLE)', 'sparsity')}, {r('(SELECT avg(w) FROM graph WHERE w > 0)', 'strength')} FROM c")
add("metrics_reciprocity", lambda b: metrics.reciprocity(b.graph), f"WITH {DEG} SELECT {r('((SELECT count(*) FROM bin a JOIN bin b ON a.src = b.dst AND a.dst = b.src) // 2) / count(*)::DOUBLE', 'reciprocity')} FROM bin")
TRACE = "(SELECT count(*) FROM bin a JOIN bin b ON a.dst = b.src JOIN bin c ON b.dst = c.src AND c.dst = a.src)"
add("metrics_clustering", lambda b: metrics.clustering_coefficient(b.graph, b.nodes), f"WITH {DEG} SELECT {r(f'{TRACE} / (count(*) * (count(*) - 1) * (count(*) - 2.0::DOUBLE))', 'clustering_coefficient')} FROM nodes")
REACH = ", r0 AS (SELECT src, dst FROM bin UNION SELECT node, node FROM nodes), " + ", ".join(f"r{i} AS (SELECT DISTINCT a.src, b.dst FROM r{i - 1} a JOIN r{i - 1} b ON a.dst = b.src)" for i in range(1, 6))
add("metrics_strong_components", lambda b: metrics.strong_components(b.graph, b.nodes), f"WITH {DEG}{REACH} SELECT a.src AS node, min(a.dst) AS component FROM r5 a JOIN r5 b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
add("metrics_components", lambda b: metrics.components(b.graph.where("w > 0.35"), b.nodes), f"WITH {GRAPH}, bin AS (SELECT src, dst FROM graph WHERE w > 0.35 UNION SELECT dst, src FROM graph WHERE w > 0.35){REACH} SELECT src AS node, min(dst) AS component FROM r5 GROUP BY 1")
add("metrics_is_connected", lambda b: metrics.is_connected(b.graph, b.nodes), f"WITH {DEG}{REACH} SELECT count(*) = (SELECT count(*) FROM nodes) AS connected FROM r5 WHERE src = (SELECT min(node) FROM nodes)")
add("metrics_spectra", lambda b: metrics.spectra(adjacency.symmetrize(b.graph), b.nodes))
add("metrics_connectivity", lambda b: metrics.connectivity(adjacency.symmetrize(b.graph), b.nodes))
add("metrics_all", lambda b: metrics.graph_metrics(b.graph, b.nodes))
add("metrics_all_undirected", lambda b: metrics.graph_metrics(adjacency.symmetrize(b.graph), b.nodes, directed=False))
PLAIN = ("edges", "density", "sparsity", "strength", "clustering_coefficient", "n_components", "is_connected", "reciprocity", "min_degree", "max_degree", "mean_degree")
add(
    "metrics_without_spectra", lambda b: metrics.graph_metrics(b.graph, b.nodes, spectral=False).select(*PLAIN),
    f"""WITH {DEG}{REACH}, u0 AS (SELECT src, dst FROM bin UNION SELECT dst, src FROM bin UNION SELECT node, node FROM nodes), {", ".join(f"u{i} AS (SELECT DISTINCT a.src, b.dst FROM u{i - 1} a JOIN u{i - 1} b ON a.dst = b.src)" for i in range(1, 6))},
    c AS (SELECT (SELECT count(*) FROM bin) AS e, (SELECT count(*) FROM nodes) AS n), s AS (SELECT a.src, min(a.dst) AS c FROM r5 a JOIN r5 b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)
    SELECT e AS edges, {r('e / (n * (n - 1.0::DOUBLE))', 'density')}, {r('1 - e / (n * n * 1.0::DOUBLE)', 'sparsity')}, {r('(SELECT avg(w) FROM graph WHERE w > 0)', 'strength')}, {r(f'{TRACE} / (n * (n - 1) * (n - 2.0::DOUBLE))', 'clustering_coefficient')},
    (SELECT count(DISTINCT c) FROM s) AS n_components, (SELECT count(*) FROM u5) = n * n AS is_connected, {r('((SELECT count(*) FROM bin a JOIN bin b ON a.src = b.dst AND a.dst = b.src) // 2) / e::DOUBLE', 'reciprocity')}, (SELECT min(deg) FROM d) AS min_degree, (SELECT max(deg) FROM d) AS max_degree, {r('(SELECT avg(deg) FROM d)', 'mean_degree')} FROM c""",
)
add("panel_feature_slice", lambda b: panels.feature_slice(datasets.sinusoidal_panel(b.spark, 3, 50, 2, noise_level=0.0), 0), f"WITH g AS (SELECT CAST(t AS INTEGER) AS t, CAST(n AS INTEGER) AS node, t * 10.0::DOUBLE / 49 AS x FROM range(50) a(t), range(3) b(n)) SELECT t, node, {r('CASE WHEN node = 0 THEN sin(x) WHEN node = 1 THEN sin(x - 0.5) ELSE sin(x) * sin(x) END', 'value')} FROM g")
add("forecast_average_neighbours", lambda b: b.spark.createDataFrame([(float(forecasting.average_neighbours(b.graph, b.nodes)),)], "average double"), f"WITH {GRAPH} SELECT {r('(SELECT count(*) FROM graph WHERE src <> dst AND w <> 0) / count(*) + 1.0::DOUBLE', 'average')} FROM nodes")


def repaired(panel: DataFrame) -> DataFrame:
    """Node 1 made constant and repaired; of its cells only those that are not repaired, or by more than the noise can be."""
    panel = panel.withColumn("value", F.when(F.col("node") == 1, 5.0).otherwise(F.col("value")))
    fixed = panels.repair_zero_variance(panel).crossJoin(F.broadcast(panels.noise_scale(panel)))
    return fixed.where("node <> 1 or value = 5 or abs(value - 5) > 9 * scale").select("t", "node", "value")


add("panel_repair_zero_variance", lambda b: repaired(b.hours), f"WITH {HOURS} SELECT t, node, {r('value')} FROM panel WHERE node <> 1")
SIDES = f"WITH {GRAPH}{COS}, o AS (SELECT src, dst, CASE WHEN w > 0.5 THEN w ELSE 0 END AS w FROM cosine), z AS (SELECT n.node AS src, m.node AS dst, coalesce(a.w, 0) AS x, coalesce(o.w, 0) AS y FROM nodes n CROSS JOIN nodes m LEFT JOIN graph a ON a.src = n.node AND a.dst = m.node LEFT JOIN o ON o.src = n.node AND o.dst = m.node)"
COUNTS = ", s AS (SELECT (SELECT count(*) FROM nodes) AS n, count(*) FILTER (x > 0) AS ea, count(*) FILTER (y > 0) AS eb, count(*) FILTER (x > 0 AND y > 0) AS c, count(*) FILTER (x > 0 OR y > 0) AS o, count(*) FILTER ((x > 0) <> (y > 0)) AS lb, sum(abs(x - y)) AS l1, sqrt(sum((x - y) * (x - y))) AS fro, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS cs, corr(x, y) AS pr FROM z)"
ENDS = ", de AS (SELECT node, (SELECT sum(x) FROM z WHERE src = node) AS oa, (SELECT sum(y) FROM z WHERE src = node) AS ob, (SELECT sum(x) FROM z WHERE dst = node) AS ia, (SELECT sum(y) FROM z WHERE dst = node) AS ib FROM nodes), dc AS (SELECT CASE WHEN stddev_pop(oa) * stddev_pop(ob) > 0 THEN covar_pop(oa, ob) / nullif(stddev_pop(oa) * stddev_pop(ob), 0) ELSE 0 END AS oc, CASE WHEN stddev_pop(ia) * stddev_pop(ib) > 0 THEN covar_pop(ia, ib) / nullif(stddev_pop(ia) * stddev_pop(ib), 0) ELSE 0 END AS ic FROM de)"
add(
    "compare_matrices", lambda b: metrics.compare(b.graph, b.cos.where("w > 0.5"), b.nodes),
    SIDES + COUNTS + ENDS + f"SELECT n AS num_nodes, {r('ea / n::DOUBLE', 'avg_degree_a')}, {r('eb / n::DOUBLE', 'avg_degree_b')}, abs(ea - eb) AS edge_difference, {r('c / o::DOUBLE', 'overlap')}, ea AS edges_a, eb AS edges_b, c AS common_edges, {r('l1', 'l1_weighted')}, {r('l1 / n', 'l1_weighted_per_node')}, {r('lb', 'l1_binary')}, {r('lb / n', 'l1_binary_per_node')}, {r('fro', 'frobenius')}, {r('c / o', 'jaccard')}, {r('c / eb', 'precision')}, {r('c / ea', 'recall')}, {r('2.0 * c / (ea + eb)', 'f1')}, {r('cs', 'cosine')}, {r('pr', 'pearson')}, {r('oc', 'out_degree_corr')}, {r('ic', 'in_degree_corr')} FROM s, dc".replace("c / o,", "c / o::DOUBLE,").replace("round(lb,", "round(lb::DOUBLE,"),
)
add("compare_spectra", lambda b: metrics.compare_spectra(adjacency.symmetrize(b.graph), b.cos, b.nodes))
add("plot_difference", lambda b: metrics.difference(b.sim, b.graph), edges_sql(GRAPH, "SELECT src, dst, sum(w) AS w FROM (SELECT * FROM sim UNION ALL SELECT src, dst, -w FROM graph) GROUP BY 1, 2"))
add("plot_heatmap", lambda b: metrics.heatmap(b.graph, b.nodes), edges_sql(GRAPH, "SELECT n.node AS src, m.node AS dst, coalesce(w, 0) AS w FROM nodes n CROSS JOIN nodes m LEFT JOIN graph g ON g.src = n.node AND g.dst = m.node"))
add("plot_spy", lambda b: metrics.sparsity_pattern(b.graph), f"WITH {GRAPH} SELECT src, dst FROM graph WHERE w <> 0")
add("plot_edge_list", lambda b: metrics.edge_list(b.graph, 0.3).select("src", "dst", "w"), edges_sql(GRAPH, "SELECT * FROM graph WHERE w > 0.3"))
add("plot_hubs", lambda b: metrics.hubs(b.graph, b.nodes, None, 5), f"WITH {GRAPH} SELECT node, {r('deg', 'w_out')} FROM deg ORDER BY deg DESC, node DESC LIMIT 5")
add("plot_hubs_percentile", lambda b: metrics.hubs(b.graph, b.nodes, 0.8), f"WITH {GRAPH} SELECT node, {r('deg', 'w_out')} FROM deg WHERE deg > (SELECT quantile_cont(deg, 0.8) FROM deg)")
add("plot_communities", lambda b: batchers.GreedyModularity().batch(b.graph, b.nodes))
add("plot_neighborhood", lambda b: metrics.neighborhood(b.graph, 3), edges_sql(GRAPH, "SELECT * FROM graph WHERE src IN (SELECT dst FROM graph WHERE src = 3 UNION SELECT src FROM graph WHERE dst = 3 UNION SELECT 3) AND dst IN (SELECT dst FROM graph WHERE src = 3 UNION SELECT src FROM graph WHERE dst = 3 UNION SELECT 3)"))
add("plot_top_connections", lambda b: metrics.top_connections(b.sim, 3, 5), f"WITH {SIM}, k AS (SELECT dst AS node FROM (SELECT dst, w FROM sim WHERE src = 3 AND dst <> 3 ORDER BY w DESC, dst DESC LIMIT 5) WHERE w > 1e-6 UNION ALL SELECT 3) SELECT {W} FROM sim WHERE abs(w) > 1e-6 AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
add("plot_batch_colours", lambda b: metrics.batch_colours(batchers.Overlapping(0.2, 1).batch(b.graph, b.nodes), b.nodes), f"WITH {SEEDS}, every AS (SELECT * FROM inside UNION ALL SELECT (SELECT count(*) FROM few), node FROM nodes WHERE node NOT IN (SELECT node FROM inside)) SELECT node, CAST(max(batch_id) AS INTEGER) AS batch_id FROM every GROUP BY 1")


def _bins(column: str, source: str, bins: int) -> str:
    return f"""v AS (SELECT {column} AS v FROM {source}), s AS (SELECT min(v) AS lo, max(v) AS hi FROM v), c AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM v, s GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, {r(f'lo + g.bin * ((hi - lo) / {bins})', 'low', 4)}, {r(f'lo + (g.bin + 1) * ((hi - lo) / {bins})', 'high', 4)}, coalesce(n, 0) AS n FROM s CROSS JOIN range({bins}) g(bin) LEFT JOIN c ON c.bin = g.bin"""


add("plot_value_histogram", lambda b: metrics.histogram(b.panel, "value", 50), f"WITH {PANEL}, {_bins('value', 'panel', 50)}", 4)
add("plot_degree_histogram", lambda b: metrics.degree_histogram(b.graph, b.nodes), f"WITH {GRAPH}, {_bins('deg', 'deg', 30)}", 4)
add("plot_weight_histogram", lambda b: metrics.edge_weight_histogram(b.graph), f"WITH {GRAPH}, {_bins('w', 'graph WHERE w > 1e-6', 50)}", 4)
add(
    "decompose", lambda b: metrics.decompose(b.hours, 2, 24),
    f"""WITH {HOURS}, o AS (SELECT t, value FROM panel WHERE node = 2),
    m AS (SELECT t, value, CASE WHEN count(*) OVER f = 25 THEN (sum(value) OVER f - (lag(value, 12) OVER (ORDER BY t) + lead(value, 12) OVER (ORDER BY t)) / 2) / 24 END AS trend FROM o WINDOW f AS (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    p AS (SELECT t % 24 AS phase, avg(value - trend) AS a FROM m GROUP BY 1), s AS (SELECT phase, a - (SELECT avg(a) FROM p) AS seasonal FROM p)
    SELECT t, {r("value")}, {r("trend")}, {r("seasonal")}, {r("value - trend - seasonal", "resid")} FROM m JOIN s ON phase = t % 24""",
)

# ------------------------------------------------------------------ forecast evaluation

SPLIT = "st AS (SELECT CAST(floor((max(t) + 1) * 0.8::DOUBLE) AS INTEGER) AS s, CAST(max(t) + 1 AS INTEGER) AS l FROM panel), org AS (SELECT CAST((o - s) // 6 AS INTEGER) AS \"window\", CAST(o AS INTEGER) AS origin FROM (SELECT s, unnest(range(s, l - 6, 6)) AS o FROM st) WHERE o >= 12)"
add("forecast_origins", lambda b: forecasting.origins(b.panel, 12, 6), f"WITH {PANEL}, {SPLIT} SELECT \"window\", origin FROM org")
FACT = "f AS (SELECT o.\"window\", p.node, CAST(p.t - o.origin AS INTEGER) AS step, p.value AS y_true, {pred} AS y_pred FROM org o JOIN panel p ON p.t >= o.origin AND p.t < o.origin + 6 {join})"
LAST = FACT.format(pred="c.value", join="JOIN panel c ON c.node = p.node AND c.t = o.origin - 1")
MEAN = FACT.format(pred="c.value", join="JOIN (SELECT o.\"window\", p.node, avg(value) AS value FROM org o JOIN panel p ON p.t >= o.origin - 12 AND p.t < o.origin GROUP BY 1, 2) c ON c.\"window\" = o.\"window\" AND c.node = p.node")
ROWS = 'SELECT "window", node, step, ' + r("y_true", digits=4) + ", " + r("y_pred", digits=4) + " FROM f"
add("forecast_eval_single_node", lambda b: forecasting.evaluate(b.panel, "single_node", forecasting.last_value, 12, 6), f"WITH {PANEL}, {SPLIT}, {LAST} {ROWS}", 4)
add("forecast_eval_whole_matrix", lambda b: forecasting.evaluate(b.panel, "whole_matrix", forecasting.window_mean, 12, 6), f"WITH {PANEL}, {SPLIT}, {MEAN} {ROWS}", 4)
add("forecast_eval_adj_neighbour", lambda b: forecasting.evaluate(b.panel, "adj_neighbour", forecasting.last_value, 12, 6, edges=b.graph), f"WITH {PANEL}, {SPLIT}, {LAST} {ROWS}", 4)
add("forecast_eval_node_batches", lambda b: forecasting.evaluate(b.panel, "node_batches", forecasting.window_mean, 12, 6, batches=batchers.FixedSize(4).batch(b.panel, b.nodes)), f"WITH {PANEL}, {SPLIT}, {MEAN} {ROWS}", 4)
ERR = ", ".join([r("avg(abs(y_true - y_pred))", "mae", 1), r("avg((y_true - y_pred) * (y_true - y_pred))", "mse", 0), r("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))", "rmse", 1), r("avg(abs(y_true - y_pred) / greatest(y_true, 1) * 100)", "mape", 1)])


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumn("mse", F.round("mse", 0) + F.lit(0.0))


add("forecast_metrics", lambda b: _measured(forecasting.metrics(forecasting.evaluate(b.panel, "single_node", forecasting.last_value, 12, 6))), f"WITH {PANEL}, {SPLIT}, {LAST} SELECT {ERR} FROM f", 1)
add("forecast_step_metrics", lambda b: _measured(forecasting.step_metrics(forecasting.evaluate(b.panel, "single_node", forecasting.last_value, 12, 6))), f"WITH {PANEL}, {SPLIT}, {LAST} SELECT step, {ERR} FROM f GROUP BY 1", 1)
add(
    "forecast_run_metrics", lambda b: forecasting.run_metrics(forecasting.evaluate(b.panel, "single_node", forecasting.last_value, 12, 6), [3, 6]).drop("mse"),
    f"WITH {PANEL}, {SPLIT}, {LAST}, e AS (SELECT h AS horizon, \"window\", avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred) / greatest(y_true, 1) * 100) AS mape FROM f, (VALUES (3), (6)) v(h) WHERE step < h GROUP BY 1, 2) SELECT horizon, count(*) AS num_eval_windows, {r('avg(mae)', 'mae', 1)}, {r('avg(rmse)', 'rmse', 1)}, {r('avg(mape)', 'mape', 1)} FROM e GROUP BY 1", 1,
)
