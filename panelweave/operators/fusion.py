"""Fusers: several similarity views of the same nodes into one matrix.

Views are edge lists over one set of nodes; they are brought together by one union and one grouping
by cell, with absent cells counted as 0."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.frames import check_nodes, cells, dense, nodes_of, single_task


def tagged(views: list[DataFrame]) -> DataFrame:
    """``view, src, dst, w``."""
    return reduce(DataFrame.union, [v.select(F.lit(i).alias("view"), "src", "dst", "w") for i, v in enumerate(views)])


class Fuser(ABC):
    def fuse(self, views: list[DataFrame], nodes: DataFrame | None = None) -> DataFrame:
        if len(views) < 2:
            raise ValueError("at least two views are needed")
        if nodes is not None:  # views are of one and the same set of nodes
            check_nodes(tagged(views), nodes)
        return self._fuse(views, nodes if nodes is not None else reduce(DataFrame.union, map(nodes_of, views)).distinct())

    __call__ = lambda self, views, nodes=None: self.fuse(views, nodes)

    @abstractmethod
    def _fuse(self, views: list[DataFrame], nodes: DataFrame) -> DataFrame: ...


class WeightedAverage(Fuser):
    """Sum of weight_i A_i with weights divided by their sum (equal by default)."""

    def __init__(self, weights: list[float] | None = None):
        self.weights = weights

    def _fuse(self, views, nodes):
        weights = self.weights or [1.0] * len(views)
        if len(weights) != len(views):
            raise ValueError(f"{len(weights)} weights for {len(views)} views")
        share = F.element_at(F.array(*[F.lit(w / sum(weights)) for w in weights]), F.col("view") + 1)
        return tagged(views).groupBy("src", "dst").agg(F.sum(F.col("w") * share).alias("w"))


class _Extreme(Fuser):
    pick: str

    def _fuse(self, views, nodes):
        pick = getattr(F, self.pick)
        undefined = F.max(F.isnan("w").cast("int")) == 1
        # a cell that some view lacks is 0 there
        held = F.when(F.count("*") < len(views), getattr(F, {"max": "greatest", "min": "least"}[self.pick])(pick("w"), F.lit(0.0))).otherwise(pick("w"))
        return tagged(views).groupBy("src", "dst").agg(F.when(undefined, float("nan")).otherwise(held).alias("w"))


class ElementWiseMax(_Extreme):
    """The largest (signed) weight of each cell; NaN if a view has NaN."""

    pick = "max"


class ElementWiseMin(_Extreme):
    pick = "min"


class RankAverage(Fuser):
    """Ordinal ranks of |w| over all N x N cells of each view, summed and brought to [0, 1].

    Cells are cut into ranges of |w| at ``cuts`` approximate quantiles of all views; ranks are counted within
    a range of a view, and the sizes of the ranges before are added, so no task sorts a whole view. A weight
    of very many cells (the absent ones, 0) is split further by its place."""

    def __init__(self, cuts: int = 64):
        self.cuts = cuts

    def _fuse(self, views, nodes):
        every = tagged([dense(v, nodes) for v in views])
        size = F.abs("w")
        at = every.agg(F.percentile_approx(size, [i / self.cuts for i in range(1, self.cuts)], 10_000)).first()[0] or []
        cuts = F.array(*[F.lit(float(c)) for c in sorted(set(at))]).cast("array<double>")
        # the range, whether |w| is the cut itself, and then the block of rows
        every = every.withColumns({"part": F.size(F.filter(cuts, lambda c: c < size)), "on": F.array_contains(cuts, size)})
        every = every.withColumn("rows", F.when(F.col("on"), F.floor(F.col("src") / 64)).otherwise(0))
        ranges = every.groupBy("view", "part", "on", "rows").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("view").orderBy("part", "on", "rows").rowsBetween(Window.unboundedPreceding, -1))
        ranges = ranges.select("view", "part", "on", "rows", F.coalesce(before, F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy("view", "part", "on", "rows").orderBy(size, "src", "dst")) - 1
        ranked = every.withColumn("r", rank).join(ranges, ["view", "part", "on", "rows"]).withColumn("r", F.col("r") + F.col("before"))
        total = ranked.groupBy("src", "dst").agg(F.sum("r").cast("double").alias("w"))
        span = F.broadcast(total.agg(F.min("w").alias("low"), F.max("w").alias("high")))
        w = F.when(F.col("high") - F.col("low") > 1e-9, (F.col("w") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))).otherwise(F.col("w"))
        return total.crossJoin(span).select("src", "dst", w.alias("w"))


def row_normalized(edges: DataFrame) -> DataFrame:
    """Each row divided by its sum (1, if that is 0)."""
    total = F.sum("w").over(Window.partitionBy("src"))
    return edges.select("src", "dst", (F.col("w") / F.when(total == 0, 1.0).otherwise(total)).alias("w"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: an equi-join on the inner index, partial sums per task."""
    left = a.select("src", F.col("dst").alias("m"), F.col("w").alias("a"))
    right = b.select(F.col("src").alias("m"), "dst", F.col("w").alias("b"))
    return left.join(right, "m").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))


class SNFDiffusion(Fuser):
    """Similarity network fusion: each view's P is diffused over its own k-nearest kernel S from the
    mean of the other views, P_i <- rownorm(S_i mean(P_j) S_i'), all at once; the result is the mean,
    made symmetric. ``mu`` is accepted and has no effect.

    ``method='kernel'`` runs the iterations on dense matrices in one task (bounded by its node limit);
    ``'distributed'`` runs them as joins; each iteration is checkpointed, or cached if the session has no
    folder for checkpoints, since a plan of many iterations grows with each."""

    def __init__(self, k_neighbors: int = 5, n_iterations: int = 20, mu: float = 0.5, method: str = "kernel"):
        self.k, self.n, self.mu, self.method = k_neighbors, n_iterations, mu, method

    def _fuse(self, views, nodes):
        return self._in_one_task(views, nodes) if self.method == "kernel" else self._distributed(views)

    def _in_one_task(self, views, nodes):
        k, iterations, count = self.k, self.n, len(views)
        # views side by side: the columns of view v are shifted by v * stride
        stride = nodes.agg(F.max("node")).first()[0] + 1
        joined = reduce(DataFrame.union, [v.where("src <> dst").select("src", (F.col("dst") + i * stride).cast("int").alias("dst"), F.abs("w").alias("w")) for i, v in enumerate(views)])

        def kernel(m, ids):
            own = ids[ids < stride]
            w = [m[np.ix_(np.searchsorted(ids, own), np.searchsorted(ids, own + i * stride))] for i in range(count)]
            p, s = [_rownorm(x) for x in w], [_rownorm(_knn(x, k)) for x in w]
            for _ in range(iterations):
                total = sum(p)
                p = [_rownorm(s[i] @ ((total - p[i]) / (count - 1)) @ s[i].T) for i in range(count)]
            mean = sum(p) / count
            return cells((mean + mean.T) / 2, own)

        grid = reduce(DataFrame.union, [nodes.select((F.col("node") + i * stride).cast("int").alias("node")) for i in range(count)])
        return single_task(joined, grid, kernel, "src int, dst int, w double")

    def _distributed(self, views):
        w = [v.where("src <> dst and w <> 0").select("src", "dst", F.abs("w").alias("w")) for v in views]
        rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), F.desc("dst")))
        s = []
        for v in w:
            near = v.withColumn("r", rank).where(F.col("r") <= self.k).select("src", "dst", F.col("w"))
            both = near.union(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
            s.append(row_normalized(both))
        p = [row_normalized(v) for v in w]
        for _ in range(self.n):
            nxt = []
            for i in range(len(p)):
                mean = tagged([x for j, x in enumerate(p) if j != i]).groupBy("src", "dst").agg((F.sum("w") / (len(p) - 1)).alias("w"))
                turned = s[i].select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
                nxt.append(row_normalized(multiply(multiply(s[i], mean), turned)))
            cut = has_checkpoint_dir(nxt[0])
            p = [x.checkpoint() if cut else x.cache() for x in nxt]
        mean = tagged(p).groupBy("src", "dst").agg((F.sum("w") / len(p)).alias("w"))
        return mean.union(mean.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def has_checkpoint_dir(df: DataFrame) -> bool:
    """Whether the session has a folder for checkpoints."""
    return df.sparkSession.sparkContext.getCheckpointDir() is not None


def _rownorm(m: np.ndarray) -> np.ndarray:
    total = m.sum(1, keepdims=True)
    return m / np.where(total == 0, 1, total)


def _knn(m: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(m)
    for i, row in enumerate(m):
        near = sorted((j for j in range(len(row)) if j != i), key=lambda j: (-row[j], -j))[:k]
        out[i, near] = row[near]
    return (out + out.T) / 2


class Attention(Fuser):
    """Per cell: the vector of views -> linear, ReLU, linear -> softmax over views -> weighted sum.

    Inference only, with given weights: ``w1[h][k], b1[h], w2[k][h], b2[k]``, as literals in the plan."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def attention(self, views: list[DataFrame], nodes: DataFrame) -> DataFrame:
        """``src, dst, x, a``: the views' weights of each cell and the attention on each."""
        held = [F.coalesce(F.max(F.when(F.col("view") == i, F.col("w"))), F.lit(0.0)) for i in range(len(views))]
        wide = tagged([dense(views[0], nodes), *views[1:]]).groupBy("src", "dst").agg(F.array(*held).alias("x"))
        linear = lambda w, b, x: F.array(*[sum((F.lit(float(c)) * F.get(x, F.lit(i)) for i, c in enumerate(r)), F.lit(float(o))) for r, o in zip(w, b, strict=True)])
        wide = wide.withColumn("h", F.transform(linear(self.w1, self.b1, F.col("x")), lambda v: F.greatest(v, F.lit(0.0))))
        wide = wide.withColumn("z", linear(self.w2, self.b2, F.col("h")))
        e = F.transform("z", lambda v: F.exp(v - F.array_max("z")))
        wide = wide.withColumn("e", e)
        return wide.select("src", "dst", "x", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda s, q: s + q)).alias("a"))

    def _fuse(self, views, nodes):
        both = F.zip_with("x", "a", lambda x, a: x * a)
        return self.attention(views, nodes).select("src", "dst", F.aggregate(both, F.lit(0.0), lambda s, v: s + v).alias("w"))


FUSERS: dict[str, type[Fuser]] = {"weighted-average": WeightedAverage, "max": ElementWiseMax, "min": ElementWiseMin, "rank-average": RankAverage, "snf": SNFDiffusion}
