"""Graph metrics, comparisons and the data behind the usual plots, mostly as plain aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.frames import dense, magnitude, single_task
from ..functions.adjacency import TINY


def binary(edges: DataFrame) -> DataFrame:
    return edges.where(F.abs("w") > TINY).select("src", "dst")


def degree_counts(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """``node, d_in, d_out, deg`` of the binary graph; nodes without an edge have 0; deg is in + out, or
    out if undirected."""
    b = binary(edges)
    ends = b.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(b.select(F.col("dst"), F.lit(1), F.lit(0)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return nodes.join(sums, "node", "left").select("node", i.alias("d_in"), o.alias("d_out"), (i + o if directed else o).alias("deg"))


def degree_distribution(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    d = degree_counts(edges, nodes, directed)
    q = lambda p: F.percentile("deg", F.lit(p))
    return d.agg(F.min("deg").alias("min_degree"), F.max("deg").alias("max_degree"), F.avg("deg").alias("mean_degree"), q(0.5).alias("median_degree"), F.mode("deg", True).alias("mode_degree"), F.stddev_pop("deg").alias("std_degree"), q(0.25).alias("q1_degree"), q(0.75).alias("q3_degree"), F.avg("d_in").alias("mean_in_degree"), F.avg("d_out").alias("mean_out_degree"))


def edge_statistics(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """One row: edges, density, sparsity, strength (mean of positive |w|)."""
    n = F.col("n").cast("double")
    counts = edges.agg(F.sum((F.abs("w") > TINY).cast("long")).alias("cells"), F.avg(F.when(F.abs("w") > 0, F.abs("w"))).alias("strength")).crossJoin(nodes.agg(F.count("*").alias("n")))
    e = F.coalesce("cells", F.lit(0)) if directed else F.floor(F.coalesce("cells", F.lit(0)) / 2)
    most = n * (n - 1) / (1 if directed else 2)
    return counts.select("n", e.alias("edges"), F.coalesce(F.try_divide(e, most), F.lit(0.0)).alias("density"), (1 - F.coalesce(F.try_divide(e, n * n), F.lit(0.0))).alias("sparsity"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """One row: (cells with both directions, the diagonal included) // 2 / cells."""
    b = binary(edges)
    back = b.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("r"))
    counts = b.join(back, ["src", "dst"], "left").agg(F.count("*").alias("e"), F.coalesce(F.sum("r"), F.lit(0)).alias("m"))
    return counts.select(F.coalesce(F.try_divide(F.floor(F.col("m") / 2), F.col("e")), F.lit(0.0)).cast("double").alias("reciprocity"))


def closed_walks(edges: DataFrame) -> DataFrame:
    """One row ``trace``: closed walks of three steps in the binary graph."""
    b = binary(edges)
    two = b.join(b.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").groupBy("src", "end").agg(F.count("*").alias("n"))
    return two.join(b.select(F.col("src").alias("end"), F.col("dst").alias("src")), ["src", "end"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trace"))


def clustering_coefficient(edges: DataFrame, nodes: DataFrame, directed: bool = True) -> DataFrame:
    """trace(A^3) / (N (N-1) (N-2)) if directed, else / (6 E)."""
    both = closed_walks(edges).crossJoin(edge_statistics(edges, nodes, directed))
    n = F.col("n").cast("double")
    by = n * (n - 1) * (n - 2) if directed else F.lit(6.0) * F.col("edges")
    return both.select(F.coalesce(F.try_divide(F.col("trace"), by), F.lit(0.0)).alias("clustering_coefficient"))


def spectra(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``kind, pos, value``: real parts of the eigenvalues of |A| (descending) and of its Laplacian
    (ascending)."""

    def kernel(m, ids):
        m = np.abs(m)
        a = np.sort(np.linalg.eigvals(m).real)[::-1]
        lap = np.sort(np.linalg.eigvals(np.diag(m.sum(1)) - m).real)
        return pd.DataFrame({"kind": ["adjacency"] * len(a) + ["laplacian"] * len(lap), "pos": [*range(len(a)), *range(len(lap))], "value": [*a, *lap]})

    return single_task(magnitude(edges), nodes, kernel, "kind string, pos int, value double")


def connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row ``algebraic_connectivity, spectral_gap``."""
    at = lambda kind, pos: F.max(F.when((F.col("kind") == kind) & (F.col("pos") == pos), F.col("value")))
    return spectra(edges, nodes).agg(F.coalesce(at("laplacian", 1), F.lit(0.0)).alias("algebraic_connectivity"), F.coalesce(at("adjacency", 0) - at("adjacency", 1), F.lit(0.0)).alias("spectral_gap"))


def _kept(df: DataFrame) -> DataFrame:
    """``df`` with its plan cut: checkpointed if the session has a folder for that, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def _settle(start: DataFrame, step, most: int = 64) -> DataFrame:
    """Repeats ``step`` on a frame of labels until a checksum of it stays; frames of earlier rounds are
    released."""
    now, before = _kept(start), None
    for _ in range(most):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first())
        if mark == before:
            return now
        before, last, now = mark, now, _kept(step(now))
        now.count()
        last.unpersist()
    raise RuntimeError("labels did not settle")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, component`` (smallest node) of the undirected graph: minimum labels with pointer
    jumping, so rounds grow with the logarithm of the diameter."""
    b = binary(edges)
    links = b.union(b.select("dst", "src")).distinct()

    def step(labels):
        near = links.join(labels.select(F.col("node").alias("dst"), "component"), "dst").select(F.col("src").alias("node"), "component")
        low = labels.union(near).groupBy("node").agg(F.min("component").alias("component"))
        return low.join(low.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", F.least("component", "up").alias("component"))

    return _settle(nodes.select("node", F.col("node").alias("component")), step)


def _reached(start: DataFrame, links: DataFrame, most: int = 10_000) -> DataFrame:
    """``node, label``: each node that links ``(src, dst)`` lead to from a node of ``start(node, label)``
    within the same ``label`` of ``links``. A round joins only the nodes found in the round before."""
    seen = front = _kept(start)
    for _ in range(most):
        found = front.join(links.withColumnRenamed("src", "node"), ["node", "label"]).select(F.col("dst").alias("node"), "label").distinct()
        new = _kept(found.join(seen, ["node", "label"], "left_anti"))
        if new.isEmpty():
            return seen
        both = _kept(seen.union(new))
        both.count()
        seen.unpersist()
        front.unpersist()
        seen, front = both, new
    raise RuntimeError("paths did not end")


def strong_components(edges: DataFrame, nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """``node, component`` (smallest node) of the strongly connected components, by colouring.

    Each node takes the smallest node that leads to it as its colour; the nodes of a colour that lead
    back to that node are a component. They are removed, and the rest goes on; every round settles a
    component per colour. Tables stay as long as the graph."""
    left = _kept(binary(edges).where("src <> dst").distinct())
    rest, done = nodes.select("node"), None
    for _ in range(most):

        def step(colours, left=left):
            near = left.join(colours.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            return colours.union(near).groupBy("node").agg(F.min("colour").alias("colour"))

        colours = _settle(rest.select("node", F.col("node").alias("colour")), step, 10_000)
        inside = left.join(colours.toDF("src", "label"), "src").join(colours.toDF("dst", "label"), ["dst", "label"])
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label")
        found = _reached(colours.where("node = colour").select("node", F.col("colour").alias("label")), back).withColumnRenamed("label", "component")
        done = found if done is None else _kept(done.union(found))
        rest = _kept(rest.join(found, "node", "left_anti"))
        if rest.isEmpty():
            return done
        gone = found.select("node")
        left = _kept(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    raise RuntimeError("components did not settle")


def is_connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row ``connected``: every node is reached from the first along edges w > 0."""
    positive = edges.where("w > 0").select("src", "dst", F.lit(0).alias("label"))
    first = nodes.agg(F.min("node").alias("node")).select("node", F.lit(0).alias("label"))
    seen = _reached(first, positive)
    return nodes.join(seen, "node", "left").agg(F.coalesce(F.min(F.coalesce(F.col("label") + 1, F.lit(0))), F.lit(1)).alias("s")).select((F.col("s") == 1).alias("connected"))


def graph_metrics(edges: DataFrame, nodes: DataFrame, directed: bool = True, spectral: bool = True) -> DataFrame:
    """All metrics of a graph in one row; those of spectra, which take a dense matrix, unless ``spectral`` is false."""
    parts = components(edges, nodes).agg(F.count_distinct("component").alias("weak_components"))
    own = (strong_components(edges, nodes).agg(F.count_distinct("component").alias("n_components")) if directed else parts.select(F.col("weak_components").alias("n_components"))).crossJoin(parts).select("n_components", (F.col("weak_components") <= 1).alias("is_connected"))
    out = degree_distribution(edges, nodes, directed)
    if not directed:
        out = out.drop("mean_in_degree", "mean_out_degree")
    for more in [edge_statistics(edges, nodes, directed), clustering_coefficient(edges, nodes, directed), *([connectivity(edges, nodes)] if spectral else []), own, *([reciprocity(edges)] if directed else [])]:
        out = out.crossJoin(more)
    return out


def compare(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of comparisons; an edge is w > 0, A is the truth. Cells that either has are joined; the
    others, zero in both, enter sums by their number. Degree correlations are of weighted degrees, sums of
    all signed weights of a row or column; ``overlap`` is the Jaccard index, 1 if neither has an edge."""
    both = a.select("src", "dst", F.col("w").alias("x")).join(b.select("src", "dst", F.col("w").alias("y")), ["src", "dst"], "full").select("src", "dst", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    i = lambda c: F.sum(c.cast("double"))
    p, q, x, y = F.col("x") > 0, F.col("y") > 0, F.col("x"), F.col("y")
    s = both.agg(i(p).alias("ea"), i(q).alias("eb"), i(p & q).alias("common"), i(p | q).alias("any"), F.sum(F.abs(x - y)).alias("l1"), i(p != q).alias("l1b"), F.sum((x - y) ** 2).alias("sq"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x).alias("sx"), F.sum(y).alias("sy")).fillna(0.0).crossJoin(nodes.agg(F.count("*").cast("double").alias("n")))
    c, n, m = F.col, F.col("n"), F.col("n") * F.col("n")
    corr = F.try_divide(c("xy") / m - c("sx") * c("sy") / (m * m), F.sqrt((c("xx") / m - (c("sx") / m) ** 2) * (c("yy") / m - (c("sy") / m) ** 2)))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    precision, recall = zero(F.try_divide(c("common"), c("eb"))), zero(F.try_divide(c("common"), c("ea")))
    out = s.select(
        n.cast("long").alias("num_nodes"), (c("ea") / n).alias("avg_degree_a"), (c("eb") / n).alias("avg_degree_b"),
        F.abs(c("ea") - c("eb")).cast("long").alias("edge_difference"), F.coalesce(F.try_divide(c("common"), c("any")), F.lit(1.0)).alias("overlap"),
        c("ea").cast("long").alias("edges_a"), c("eb").cast("long").alias("edges_b"), c("common").cast("long").alias("common_edges"),
        c("l1").alias("l1_weighted"), (c("l1") / n).alias("l1_weighted_per_node"), c("l1b").alias("l1_binary"), (c("l1b") / n).alias("l1_binary_per_node"), F.sqrt("sq").alias("frobenius"),
        (c("common") / (c("any") + F.lit(1e-12))).alias("jaccard"), precision.alias("precision"), recall.alias("recall"),
        zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"), zero(F.try_divide(c("xy"), F.sqrt(c("xx") * c("yy")))).alias("cosine"), zero(corr).alias("pearson"),
    )
    wide = nodes
    for e, names in ((a, ("ia", "oa")), (b, ("ib", "ob"))):
        wide = wide.join(weighted_degrees(e, nodes).toDF("node", *names), "node")

    def corr_of(u, v):
        return zero(F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v)))

    return out.crossJoin(wide.agg(corr_of("oa", "ob").alias("out_degree_corr"), corr_of("ia", "ib").alias("in_degree_corr")))


def compare_spectra(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: L2 between sorted real spectra of the matrices and of their Laplacians, and the
    difference of spectral energies."""
    n = nodes.count()
    side = a.select("src", "dst", "w").union(b.select("src", (F.col("dst") + n).cast("int"), "w"))
    every = nodes.union(nodes.select((F.col("node") + n).cast("int")))

    def kernel(m, ids):
        x, y = m[:n, :n], m[:n, n:]
        ev = lambda z: np.sort(np.linalg.eigvals(z).real)
        lap = lambda z: np.diag(z.sum(1)) - z
        ex, ey = ev(x), ev(y)
        return pd.DataFrame({"spectral_l2": [np.linalg.norm(ex - ey)], "laplacian_l2": [np.linalg.norm(ev(lap(x)) - ev(lap(y)))], "energy_difference": [abs((ex**2).sum() - (ey**2).sum())]})

    return single_task(side, every, kernel, "spectral_l2 double, laplacian_l2 double, energy_difference double")


# ------------------------------------------------------------------ data behind plots


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of A - B where either has one."""
    return a.select("src", "dst", "w").union(b.select("src", "dst", (-F.col("w")).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def sparsity_pattern(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0").select("src", "dst")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """``bin, low, high, n``: equal bins over the range, the last one closed; empty bins have 0."""
    v = F.col(column).cast("double")
    span = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)).cast("int"))
    counts = values.where(v.isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = span.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def weighted_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, w_in, w_out``."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0.0).alias("i"), F.col("w").alias("o")).union(edges.select("dst", "w", F.lit(0.0)))
    sums = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("i", F.lit(0.0)).alias("w_in"), F.coalesce("o", F.lit(0.0)).alias("w_out"))


def degree_histogram(edges: DataFrame, nodes: DataFrame, direction: str = "out", bins: int = 30) -> DataFrame:
    return histogram(weighted_degrees(edges, nodes), f"w_{direction}", bins)


def edge_weight_histogram(edges: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(edges.where(F.col("w") > TINY), "w", bins)


def hubs(edges: DataFrame, nodes: DataFrame, hub_threshold: float | None = None, top_k: int = 10) -> DataFrame:
    """``node, w_out`` of the hubs: above a percentile (threshold < 1), above a value, or the top k."""
    d = weighted_degrees(edges, nodes).select("node", "w_out")
    if hub_threshold is None:
        return d.orderBy(F.desc("w_out"), F.desc("node")).limit(top_k)
    limit = d.agg((F.percentile("w_out", F.lit(hub_threshold)) if hub_threshold < 1 else F.lit(float(hub_threshold))).alias("limit"))
    return d.join(F.broadcast(limit), F.col("w_out") > F.col("limit")).select("node", "w_out")


def neighborhood(edges: DataFrame, node: int) -> DataFrame:
    """The sub-graph of a node and its in- and out-neighbours (|w| > 1e-6)."""
    b = edges.where(F.abs("w") > TINY)
    near = b.where(F.col("src") == node).select(F.col("dst").alias("node")).union(b.where(F.col("dst") == node).select("src")).union(edges.sparkSession.range(1).select(F.lit(node))).distinct()
    return induced(edges, near)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.where(F.abs("w") > TINY).join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def top_connections(edges: DataFrame, node: int, k: int = 5) -> DataFrame:
    """The sub-graph of a node and its k largest signed weights above 1e-6."""
    top = edges.where((F.col("src") == node) & (F.col("dst") != node)).orderBy(F.desc("w"), F.desc("dst")).limit(k).where(F.col("w") > TINY).select(F.col("dst").alias("node"))
    return induced(edges, top.union(edges.sparkSession.range(1).select(F.lit(node))))


def batch_colours(batches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, batch_id``: the last batch of each node; -1 for nodes in none."""
    last = batches.groupBy("node").agg(F.max("batch_id").alias("batch_id"))
    return nodes.join(last, "node", "left").select("node", F.coalesce("batch_id", F.lit(-1)).alias("batch_id"))


def heatmap(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return dense(edges, nodes)


def edge_list(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges above a threshold with their weight labels."""
    return edges.where(F.col("w") > threshold).select("src", "dst", "w", F.format_string("%.2f", "w").alias("label"))


# ------------------------------------------------------------------ series statistics


def panel_statistics(panel: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return panel.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), q(0.001).alias("p0_1"), q(0.999).alias("p99_9"))


def decompose(panel: DataFrame, node: int, period: int) -> DataFrame:
    """Additive decomposition ``t, value, trend, seasonal, resid`` of one node: a centred moving
    average (of period + 1 points with halved ends, if the period is even), the mean of each phase less
    their mean, and the rest. Raises unless there are two periods."""
    one = panel.where(F.col("node") == node).select("t", "value")
    n = one.count()
    if n < 2 * period:
        raise ValueError(f"{n} steps are less than two periods of {period}")
    order = Window.orderBy("t")
    half = period // 2
    frame = order.rowsBetween(-half, half)
    full = F.count("*").over(frame) == 2 * half + 1
    total = F.sum("value").over(frame)
    if period % 2 == 0:
        total = total - (F.lag("value", half).over(order) + F.lead("value", half).over(order)) / 2
    trended = one.withColumn("trend", F.when(full, total / period)).withColumn("phase", F.col("t") % period)
    phase = trended.groupBy("phase").agg(F.avg(F.col("value") - F.col("trend")).alias("mean"))
    phase = phase.select("phase", (F.col("mean") - F.avg("mean").over(Window.partitionBy())).alias("seasonal"))
    return trended.join(phase, "phase").select("t", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))


def node_series(panel: DataFrame, node: int, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A node's series, between ``start`` and ``stop`` if given; bounds out of order raise ValueError."""
    if start is not None and stop is not None and start >= stop:
        raise ValueError(f"empty range {start}..{stop}")
    out = panel.where(F.col("node") == node)
    out = out if start is None else out.where(F.col("t") >= start)
    out = out if stop is None else out.where(F.col("t") < stop)
    return out.select("t", "value")
