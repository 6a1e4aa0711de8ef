"""Sparsifiers: each chooses cells of a similarity matrix, a mask ``(src, dst)``.

Masks rank |w| without the diagonal; undefined (null or NaN) cells are never chosen. Ties go to the
larger dst (per row) or the larger (src, dst). Undirected masks hold both (i, j) and (j, i).
"""

from __future__ import annotations

import heapq
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.frames import nodes_of, select_mask, single_task
from .planarity import is_planar

MASK = "src int, dst int"


def candidates(edges: DataFrame) -> DataFrame:
    """Defined off-diagonal cells with |w|."""
    return edges.where("src <> dst and w is not null and not isnan(w)").select("src", "dst", F.abs("w").alias("w"))


def _both(upper: DataFrame) -> DataFrame:
    return upper.select("src", "dst").union(upper.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _mask(pairs) -> pd.DataFrame:
    pairs = list(pairs)
    return pd.DataFrame({"src": [p[0] for p in pairs], "dst": [p[1] for p in pairs]}, dtype=np.int32)


class Sparsifier(ABC):
    @abstractmethod
    def mask(self, edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame: ...

    def apply(self, edges: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
        """The chosen cells with their signed weights."""
        return select_mask(edges, self.mask(edges, nodes_of(edges) if nodes is None else nodes, k))


class TopKRow(Sparsifier):
    """The k cells of the largest |w| of each row; k is ``k_per_node``, else the budget / N."""

    def __init__(self, k_per_node: int | None = None):
        self.k_per_node = k_per_node

    def _k(self, nodes, k):
        return self.k_per_node if self.k_per_node is not None else k // max(1, nodes.count())

    def mask(self, edges, nodes, k):
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.desc("dst")))
        return candidates(edges).withColumn("r", rank).where(F.col("r") <= self._k(nodes, k)).select("src", "dst")


class NeighbourK(Sparsifier):
    """As many cells per row as a prior graph has non-zero ones there."""

    def __init__(self, prior: DataFrame):
        self.prior = prior

    def mask(self, edges, nodes, k):
        wanted = self.prior.where("abs(w) > 0").groupBy("src").agg(F.count("*").alias("k"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.desc("dst")))
        return candidates(edges).withColumn("r", rank).join(wanted, "src").where("r <= k").select("src", "dst")


class GlobalTopE(Sparsifier):
    """The E cells of the largest |w| (a bounded top list per task); undirected: E pairs."""

    def __init__(self, directed: bool = True):
        self.directed = directed

    def mask(self, edges, nodes, k):
        c = candidates(edges) if self.directed else candidates(edges).where("src < dst")
        top = c.orderBy(F.desc("w"), F.desc("src"), F.desc("dst")).limit(k).select("src", "dst")
        return top if self.directed else _both(top)


class DegreeGreedy(Sparsifier):
    """Takes again and again the cell with the largest |w| - penalty (deg_i + deg_j). Scores only fall,
    so a heap whose stale top is put back with its new score gives the exact order. One task."""

    def __init__(self, penalty_factor: float = 0.1, directed: bool = True):
        self.penalty_factor, self.directed = penalty_factor, directed

    def mask(self, edges, nodes, k):
        p, directed = self.penalty_factor, self.directed

        def kernel(m, ids):
            n = len(m)
            heap = [(-m[i, j], i, j) for i in range(n) for j in range(n) if i != j and (directed or i < j)]
            heapq.heapify(heap)
            degree, out = [0] * n, []
            while heap and len(out) < k:
                score, i, j = heapq.heappop(heap)
                now = -(m[i, j] - p * (degree[i] + degree[j]))
                if now > score + 1e-9:
                    heapq.heappush(heap, (now, i, j))
                    continue
                out.append((ids[i], ids[j]))
                degree[i] += 1
                degree[j] += 1
            return _mask(out if directed else [*out, *((b, a) for a, b in out)])

        return single_task(candidates(edges), nodes, kernel, MASK)


class ThresholdBudget(Sparsifier):
    """|w| above a threshold found by bisection of [0, high] so that about ``k`` cells (pairs, if
    undirected) are above it; stops within ``tol`` of k or when the interval is under 1e-6.

    Each step is one count. ``high=None`` takes the largest |w| instead of 1."""

    def __init__(self, directed: bool = True, tol: float = 0.02, high: float | None = 1.0):
        self.directed, self.tol, self.high = directed, tol, high

    def threshold(self, edges, nodes, k) -> float | None:
        c = candidates(edges) if self.directed else candidates(edges).where("src < dst")
        n = nodes.count()
        if k >= (n * (n - 1) if self.directed else n * (n - 1) // 2):
            return None
        c = c.select("w").cache()
        low, high = 0.0, self.high if self.high is not None else (c.agg(F.max("w")).first()[0] or 1.0)
        middle = (low + high) / 2
        while high - low >= 1e-6:
            middle = (low + high) / 2
            n_above = c.where(F.col("w") > middle).count()
            if abs(n_above - k) <= self.tol * k:
                break
            low, high = (middle, high) if n_above > k else (low, middle)
        c.unpersist()
        return middle

    def mask(self, edges, nodes, k):
        limit = self.threshold(edges, nodes, k)
        c = candidates(edges)
        if not self.directed:
            c = c.where("src < dst")
        chosen = c if limit is None else c.where(F.col("w") > F.lit(limit))
        return chosen.select("src", "dst") if self.directed else _both(chosen)


class KnnWithBudget(Sparsifier):
    """Per-row top ``k_local`` (or its transpose, if undirected), then the budget: directed keeps all
    cells at least as large as the k-th largest, undirected the E largest pairs."""

    def __init__(self, k_local: int = 8, directed: bool = True):
        self.k_local, self.directed = k_local, directed

    def mask(self, edges, nodes, k):
        local = TopKRow(self.k_local).mask(edges, nodes, k)
        if self.directed:
            chosen = select_mask(candidates(edges), local)
            last = chosen.orderBy(F.desc("w")).limit(k).agg(F.count("*").alias("n"), F.min("w").alias("last"))
            return chosen.join(F.broadcast(last), F.col("w") >= F.col("last")).select("src", "dst")
        pairs = local.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        return GlobalTopE(directed=False).mask(select_mask(candidates(edges), pairs), nodes, k)


def maximum_spanning_forest(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``src, dst, w`` (src < dst) of the maximum spanning forest of |w|, ties by (src, dst) descending.

    A forest of a union is the forest of the parts' forests: each task keeps the forest of its own
    edges (N - 1 at most), so do a few tasks with what is left, and one task joins theirs."""

    def forest(frames):
        held = pd.concat([f for f in frames] or [pd.DataFrame({"src": [], "dst": [], "w": []})])
        held = held.sort_values(["w", "src", "dst"], ascending=False)
        parent: dict[int, int] = {}

        def root(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        keep = []
        for i, (a, b) in enumerate(zip(held["src"], held["dst"], strict=True)):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[ra] = rb
                keep.append(i)
        yield held.iloc[keep].astype({"src": "int32", "dst": "int32", "w": float})

    upper = candidates(edges).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("w").alias("w")).where("w > 0")
    schema = "src int, dst int, w double"
    few = upper.mapInPandas(forest, schema).repartition(16, "src", "dst").mapInPandas(forest, schema)
    return few.repartition(1).mapInPandas(forest, schema)


class MST(Sparsifier):
    """Maximum spanning forest of |w|, both directions; the budget plays no part. With ``use_knn_hybrid``
    each row's top ``k_hybrid`` other nodes come on top."""

    def __init__(self, use_knn_hybrid: bool = False, k_hybrid: int = 5):
        self.use_knn_hybrid, self.k_hybrid = use_knn_hybrid, k_hybrid

    def mask(self, edges, nodes, k):
        out = _both(maximum_spanning_forest(edges, nodes))
        if self.use_knn_hybrid:
            out = out.union(_both(TopKRow(self.k_hybrid).mask(edges, nodes, k))).distinct()
        return out


class SpectralProxy(Sparsifier):
    """Pairs by w (1 / deg_i + 1 / deg_j), after a maximum spanning tree if ``ensure_connected``, up to
    ``k`` pairs."""

    def __init__(self, ensure_connected: bool = True, eps: float = 1e-12):
        self.ensure_connected, self.eps = ensure_connected, eps

    def mask(self, edges, nodes, k):
        c = candidates(edges)
        share = c.groupBy("src").agg((1 / (F.sum("w") + F.lit(self.eps))).alias("f"))
        scored = c.where("src < dst").join(share, "src").join(share.select(F.col("src").alias("dst"), F.col("f").alias("g")), "dst")
        scored = scored.where("w > 0").select("src", "dst", "w", (F.col("w") * (F.col("f") + F.col("g"))).alias("score"), F.lit(0).alias("first"))
        if self.ensure_connected:
            tree = maximum_spanning_forest(edges, nodes).select("src", "dst", F.lit(1).alias("tree"))
            scored = scored.join(tree, ["src", "dst"], "left").withColumn("first", F.coalesce("tree", F.lit(0)))
        # tree edges enter by weight, the others by score
        order = [F.desc("first"), F.desc(F.when(F.col("first") == 1, F.col("w")).otherwise(F.col("score"))), F.desc("w"), F.asc("src"), F.asc("dst")]
        return _both(scored.orderBy(*order).limit(k))


class ResistanceSampling(Sparsifier):
    """Samples ``k`` pairs with replacement by w times effective resistance; the mask is the distinct ones.

    The pseudo-inverse is made in one task; the draw is a search in running sums, in the same task."""

    def __init__(self, directed: bool = True, seed: int | None = None):
        self.directed, self.seed = directed, 0 if seed is None else seed

    def sample(self, edges, nodes, k) -> DataFrame:
        """``src, dst, w, p, n, new_w``: sampled cells, their probability, how often they were drawn, and
        the weight n w / (k p) that makes the sample unbiased."""
        directed, seed = self.directed, self.seed

        def kernel(m, ids):
            sym = (m + m.T) / 2
            inverse = np.linalg.pinv(np.diag(sym.sum(1)) - sym, rcond=1e-12)
            d = np.diag(inverse)
            r = np.maximum(d[:, None] + d[None, :] - 2 * inverse, 0)
            i, j = np.nonzero(m if directed else np.triu(m))
            w = m[i, j]
            score = w * r[i, j]
            if score.sum() <= 0:
                score = (w > 0).astype(float)
            if not len(w) or score.sum() <= 0 or k <= 0:
                return pd.DataFrame({"src": [], "dst": [], "w": [], "p": [], "n": [], "new_w": []})
            p = score / score.sum()
            n = np.bincount(np.random.default_rng(seed).choice(len(p), k, p=p), minlength=len(p))
            s = n > 0
            return pd.DataFrame({"src": ids[i[s]], "dst": ids[j[s]], "w": w[s], "p": p[s], "n": n[s], "new_w": n[s] * w[s] / (k * p[s])})

        return single_task(candidates(edges), nodes, kernel, "src int, dst int, w double, p double, n long, new_w double")

    def mask(self, edges, nodes, k):
        s = self.sample(edges, nodes, k).select("src", "dst")
        return s if self.directed else _both(s)


class DHondt(Sparsifier):
    """Seats by highest quotient. ``sum_correlation``: the node with the largest sum |w| / (deg + 1)
    takes its best free cell; ``top_edge``: the quotient is the best free cell's |w| / (deg + 1). Both ends'
    degrees rise by 1; saturated rows and the diagonal don't take part. Of equal quotients, which the two ends of
    a best pair have in a symmetric matrix, the smaller row's wins. One task."""

    def __init__(self, mode: str = "sum_correlation", directed: bool = True):
        self.mode, self.directed = mode, directed

    def mask(self, edges, nodes, k):
        by_sum, directed = self.mode == "sum_correlation", self.directed

        def kernel(m, ids):
            n = len(m)
            free = m.copy()
            np.fill_diagonal(free, -1.0)
            total, degree, out = m.sum(1), np.zeros(n), []
            while len(out) < k:
                best = free.max(1, initial=-1.0)
                quotient = np.where(best >= 0, (total if by_sum else best) / (degree + 1), -1.0)
                i = int(quotient.argmax()) if n else -1
                if i < 0 or quotient[i] <= 0:
                    break
                j = int(np.flatnonzero(free[i] == best[i])[-1])
                out.append((ids[i], ids[j]))
                free[i, j] = -1.0
                if not directed:
                    free[j, i] = -1.0
                degree[i] += 1
                degree[j] += 1
            return _mask(out if directed else [*out, *((b, a) for a, b in out)])

        return single_task(candidates(edges), nodes, kernel, MASK)


class MutualKnn(Sparsifier):
    """Pairs that are in each other's per-row top k."""

    def __init__(self, k_per_node: int | None = None):
        self.k_per_node = k_per_node

    def mask(self, edges, nodes, k):
        top = TopKRow(self.k_per_node).mask(edges, nodes, k)
        return top.join(top.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


class PMFG(Sparsifier):
    """Planar maximally filtered graph: pairs by falling |w| as long as the graph stays planar, up to
    3 (N - 2); the budget plays no part. One task."""

    def mask(self, edges, nodes, k):
        def kernel(m, ids):
            n = len(m)
            m = np.maximum(m, m.T)
            order = sorted(((m[i, j], i, j) for i in range(n) for j in range(i + 1, n) if m[i, j] > 0), reverse=True)
            kept, most = [], 3 * (n - 2) if n > 2 else n - 1
            for _, i, j in order:
                if len(kept) >= most:
                    break
                if is_planar([*kept, (i, j)]):
                    kept.append((i, j))
            return _mask([(ids[i], ids[j]) for i, j in kept] + [(ids[j], ids[i]) for i, j in kept])

        return single_task(candidates(edges), nodes, kernel, MASK)


SPARSIFIERS: dict[str, type[Sparsifier]] = {
    "top-k-row": TopKRow,
    "top-k-global": GlobalTopE,
    "greedy-degree-regularize": DegreeGreedy,
    "threshold-mask": ThresholdBudget,
    "top-k-row-global-limit": KnnWithBudget,
    "spectral-sparce": SpectralProxy,
    "strict-spectral-sparce": ResistanceSampling,
    "dhondt": DHondt,
    "mutual-knn": MutualKnn,
    "mst": MST,
    "pmfg": PMFG,
}
