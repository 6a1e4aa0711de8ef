"""Node batchers: edges -> ``batches(batch_id, pos, node)``.

Greedy and spectral batchers work on one dense matrix in one task; ids ascend wherever the order of
a set would decide. Neighbourhoods are unweighted and undirected.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.frames import KERNEL_NODES, check_nodes, nodes_of, single_task

BATCHES = "batch_id int, pos int, node int"


def _frame(batches: list[list[int]], ids: np.ndarray) -> pd.DataFrame:
    rows = [(b, p, int(ids[n])) for b, batch in enumerate(batches) for p, n in enumerate(batch)]
    return pd.DataFrame(rows, columns=["batch_id", "pos", "node"]).astype("int32")


def _groups(labels: np.ndarray) -> list[list[int]]:
    """Members by label, in the order of each group's smallest member."""
    found = [np.flatnonzero(labels == x).tolist() for x in np.unique(labels)]
    return sorted(found, key=lambda g: g[0])


class Batcher(ABC):
    @abstractmethod
    def batch(self, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame: ...

    __call__ = lambda self, edges, nodes=None: self.batch(edges, nodes)


class _Kernel(Batcher):
    def batch(self, edges, nodes=None):
        own: Callable = self.batches
        return single_task(edges.select("src", "dst", "w"), nodes if nodes is not None else nodes_of(edges), lambda m, ids: _frame(own(m), ids), BATCHES)

    def batches(self, m: np.ndarray) -> list[list[int]]:
        raise NotImplementedError


def hops(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``seed, node, hop``: nodes within k steps of each seed, directions and weights aside."""
    links = edges.where("w <> 0 and src <> dst").select("src", "dst")
    links = links.union(links.select(F.col("dst"), F.col("src"))).distinct()
    out = nodes.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop"))
    front = out
    for step in range(1, k + 1):
        front = front.join(links.withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct().withColumn("hop", F.lit(step))
        front = front.join(out.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "hop")
        out = out.union(front)
    return out


class KHop(Batcher):
    """The lowest unassigned node takes the unassigned nodes within k hops (over the whole graph), up to
    ``max_batch_size``, nearest and lowest first. Hops are joins; the cover pass is one task."""

    def __init__(self, k: int = 1, max_batch_size: int | None = None):
        self.k, self.most = k, max_batch_size

    def batch(self, edges, nodes=None):
        if nodes is not None:
            check_nodes(edges, nodes)
        nodes = nodes if nodes is not None else nodes_of(edges)
        most = self.most

        def kernel(pdf):
            if pdf["seed"].nunique() > KERNEL_NODES:
                raise ValueError(f"{pdf['seed'].nunique()} nodes; this operator takes {KERNEL_NODES} at most")
            near = {s: g.sort_values(["hop", "node"])["node"].tolist() for s, g in pdf.groupby("seed")}
            free, out = set(near), []
            for seed in sorted(near):
                if seed in free:
                    batch = [n for n in near[seed] if n in free][:most]
                    free -= set(batch)
                    out.append(batch)
            return pd.DataFrame([(b, p, n) for b, batch in enumerate(out) for p, n in enumerate(batch)], columns=["batch_id", "pos", "node"])

        return hops(edges, nodes, self.k).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(kernel, BATCHES)


class GreedyCluster(_Kernel):
    """From the lowest free node, the strongest edge from the batch to a free node is followed until none
    is positive or the batch is full."""

    def __init__(self, max_batch_size: int = 32):
        self.most = max_batch_size

    def batches(self, m):
        free, out = set(range(len(m))), []
        while free:
            batch = [min(free)]
            free.discard(batch[0])
            reach = m[batch[0]].copy()
            while free and len(batch) < self.most:
                best = max(free, key=lambda j: (reach[j], -j))
                if reach[best] <= 0:
                    break
                batch.append(best)
                free.discard(best)
                reach = np.maximum(reach, m[best])
            out.append(batch)
        return out


def modularity(m: np.ndarray, labels: np.ndarray, resolution: float = 1.0) -> float:
    total = m.sum()
    if total == 0:
        return 0.0
    d = m.sum(1)
    same = labels[:, None] == labels[None, :]
    return float(((m - resolution * np.outer(d, d) / total) * same).sum() / total)


class Louvain(_Kernel):
    """Louvain communities of (A + A') / 2: nodes move to the neighbouring community of the largest gain,
    in id order, until none gains; communities become nodes; and so on. Deterministic."""

    def __init__(self, resolution: float = 1.0):
        self.resolution = resolution

    def batches(self, m):
        m = np.maximum((m + m.T) / 2, 0)
        groups = np.arange(len(m))
        while True:
            labels = self._moved(m)
            names, labels = np.unique(labels, return_inverse=True)
            groups = labels[groups]
            if len(names) == len(m):
                return _groups(groups)
            join = np.eye(len(names))[labels]
            m = join.T @ m @ join

    def _moved(self, m):
        n, d, total = len(m), m.sum(1), m.sum()
        labels = np.arange(n)
        if total == 0:
            return labels
        weight = d.copy()  # of each community
        moved = True
        while moved:
            moved = False
            for i in range(n):
                own = labels[i]
                weight[own] -= d[i]
                to = np.bincount(labels, m[i], n)
                to[own] -= m[i, i]
                gain = to - self.resolution * d[i] * weight / total
                gain[np.setdiff1d(np.arange(n), np.append(labels[m[i] > 0], own))] = -np.inf
                best = int(gain.argmax())
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                weight[best] += d[i]
                if best != own:
                    labels[i], moved = best, True
        return labels


class CompleteLinkage(_Kernel):
    """Complete-linkage clusters of the distance max(A) - A, down to ``n_clusters`` (5) or up to
    ``distance_threshold``."""

    def __init__(self, n_clusters: int | None = None, distance_threshold: float | None = None):
        self.n, self.limit = n_clusters if n_clusters or distance_threshold is not None else 5, distance_threshold

    def batches(self, m):
        dist = np.maximum(m.max(initial=0) - (m + m.T) / 2, 0)
        np.fill_diagonal(dist, np.inf)
        members = {i: [i] for i in range(len(m))}
        while len(members) > (self.n or 1):
            i, j = np.unravel_index(int(dist.argmin()), dist.shape)
            if not np.isfinite(dist[i, j]) or (self.limit is not None and dist[i, j] >= self.limit):
                break
            i, j = min(i, j), max(i, j)
            members[i] += members.pop(j)
            dist[i] = dist[:, i] = np.maximum(dist[i], dist[j])
            dist[i, i] = np.inf
            dist[j] = dist[:, j] = np.inf
        return sorted((sorted(g) for g in members.values()), key=lambda g: g[0])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    r = np.random.default_rng(seed)
    best = (np.inf, np.zeros(len(x), int))
    for _ in range(10):
        centres = x[[r.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack((centres, x[[r.choice(len(x), p=d / d.sum()) if d.sum() else r.integers(len(x))]]))
        for _ in range(rounds):
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            labels = d.argmin(1)
            new = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        best = min(best, (float(d.min(1).sum()), labels), key=lambda b: b[0])
    return best[1]


class Spectral(_Kernel):
    """k-means of the leading eigenvectors of the normalized affinity max((A + A') / 2, 0)."""

    def __init__(self, n_clusters: int = 5, seed: int = 42):
        self.n, self.seed = n_clusters, seed

    def batches(self, m):
        a = np.maximum((m + m.T) / 2, 0)
        k = min(self.n, len(a))
        d = a.sum(1)
        f = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        _, v = np.linalg.eigh(f[:, None] * a * f[None, :])
        return _groups(_kmeans(v[:, -k:] * f[:, None] if (d > 0).all() else v[:, -k:], k, self.seed))


class BalancedPartition(_Kernel):
    """Chunks of ceil(N / n) of the nodes sorted by the Fiedler vector of the weighted Laplacian of
    (A + A') / 2; the vector's first non-zero entry is made positive."""

    def __init__(self, n_clusters: int = 5):
        self.n = n_clusters

    def batches(self, m):
        a = (m + m.T) / 2
        n = len(a)
        if n < 2:
            return [list(range(n))]
        _, v = np.linalg.eigh(np.diag(a.sum(1)) - a)
        f = v[:, 1]
        first = np.flatnonzero(np.abs(f) > 1e-12)
        f = f * (np.sign(f[first[0]]) if len(first) else 1)
        order = np.lexsort((np.arange(n), f)).tolist()
        size = -(-n // self.n)
        return [order[i : i + size] for i in range(0, n, size)]


class Overlapping(Batcher):
    """Ego networks of the given radius around the int(N f) (1 at least) nodes of the highest unweighted
    degree (a self-loop counts twice), and one batch of what they leave out. Joins only."""

    def __init__(self, seed_fraction: float = 0.5, radius: int = 1):
        self.f, self.radius = seed_fraction, radius

    def batch(self, edges, nodes=None):
        nodes = nodes if nodes is not None else nodes_of(edges)
        links = edges.where("w <> 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
        n = max(1, int(nodes.count() * self.f))
        ranked = nodes.join(degree, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg")).orderBy(F.desc("deg"), F.desc("node")).limit(n)
        seeds = ranked.withColumn("batch_id", F.row_number().over(Window.orderBy(F.desc("deg"), F.desc("node"))) - 1)
        ego = hops(edges, seeds.select("node"), self.radius)
        pos = F.row_number().over(Window.partitionBy("batch_id").orderBy("node")) - 1
        inside = ego.join(seeds.select(F.col("node").alias("seed"), "batch_id"), "seed").select("batch_id", "node")
        outside = nodes.join(ego.select("node").distinct(), "node", "left_anti").select(F.lit(n).alias("batch_id"), "node")
        return inside.union(outside).withColumn("pos", pos).select("batch_id", "pos", "node")


class DegreeAware(_Kernel):
    """By falling weighted degree, each free node takes its strongest positive free neighbours, up to
    int(max(2, base_size - degree scale_factor)) nodes in all."""

    def __init__(self, base_size: int = 32, scale_factor: float = 0.5):
        self.base, self.scale = base_size, scale_factor

    def batches(self, m):
        u = np.where((m != 0) & (m.T != 0), np.tril(m) + np.tril(m, -1).T, m + m.T * (m == 0))
        degree = u.sum(1) + np.diag(u)
        free, out = set(range(len(m))), []
        for seed in sorted(range(len(m)), key=lambda i: (-degree[i], i)):
            if seed not in free:
                continue
            size = int(max(2, self.base - degree[seed] * self.scale))
            near = sorted((j for j in free if j != seed and u[seed, j] > 0), key=lambda j: (-u[seed, j], j))
            batch = [seed, *near[: size - 1]]
            free -= set(batch)
            out.append(batch)
        return out


class FixedSize(Batcher):
    """Consecutive nodes, ``size`` at a time."""

    def __init__(self, size: int):
        self.size = size

    def batch(self, edges, nodes=None):
        nodes = nodes if nodes is not None else nodes_of(edges)
        return nodes.select(F.floor(F.col("node") / self.size).cast("int").alias("batch_id"), (F.col("node") % self.size).cast("int").alias("pos"), "node")


class GreedyModularity(_Kernel):
    """Communities by joining, again and again, the two whose union raises modularity most."""

    def batches(self, m):
        a = np.maximum((m + m.T) / 2, 0)
        np.fill_diagonal(a, 0)
        total, members = a.sum(), {i: [i] for i in range(len(a))}
        if total == 0:
            return [[i] for i in members]
        e, d = a / total, a.sum(1) / total
        alive = np.ones(len(a), bool)
        while True:
            gain = np.where((e > 0) & alive[:, None] & alive[None, :], 2 * (e - np.outer(d, d)), -np.inf)
            np.fill_diagonal(gain, -np.inf)
            i, j = np.unravel_index(int(gain.argmax()), gain.shape) if len(a) else (0, 0)
            if not len(a) or gain[i, j] <= 1e-12:
                return sorted((sorted(g) for g in members.values()), key=lambda g: g[0])
            i, j = min(i, j), max(i, j)
            e[i] += e[j]
            e[:, i] += e[:, j]
            d[i] += d[j]
            alive[j] = False
            members[i] += members.pop(j)


BATCHERS: dict[str, type[Batcher]] = {
    "k-hop": KHop, "greedy-cluster": GreedyCluster, "louvain": Louvain, "complete-linkage": CompleteLinkage, "spectral": Spectral,
    "balanced": BalancedPartition, "overlapping": Overlapping, "degree-aware": DegreeAware, "fixed": FixedSize, "greedy-modularity": GreedyModularity,
}


def summary(batches: DataFrame) -> DataFrame:
    """One row: number of batches, and the mean, largest and smallest size."""
    sizes = batches.groupBy("batch_id").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("n_batches"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), F.min("size").alias("min_size"))


def validate_batches(correlation: DataFrame, batches: DataFrame) -> DataFrame:
    """One row ``intra, inter, ratio, valid``: the mean |correlation| of pairs inside batches of two or
    more, against that of members with nodes outside; valid if intra is the larger."""
    r = correlation.where("w is not null").select("src", "dst", F.abs("w").alias("w"))
    b = batches.select("batch_id", "node").distinct()
    b = b.join(b.groupBy("batch_id").count().where("count >= 2").select("batch_id"), "batch_id", "left_semi")
    from_ = r.join(b.select("batch_id", F.col("node").alias("src")), "src")
    to = b.select("batch_id", F.col("node").alias("dst"))
    inside = from_.join(to, ["batch_id", "dst"], "left_semi").where("src < dst").agg(F.avg("w").alias("intra"))
    outside = from_.join(to, ["batch_id", "dst"], "left_anti").agg(F.avg("w").alias("inter"))
    both = inside.crossJoin(outside)
    return both.select("intra", "inter", F.try_divide("intra", "inter").alias("ratio"), F.coalesce(F.col("intra") > F.col("inter"), F.lit(False)).alias("valid"))


def as_json(batches: DataFrame) -> DataFrame:
    """One row ``json``: [[node, ...], ...] in order."""
    inner = batches.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("nodes"))
    return inner.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("batch_id", "nodes"))), lambda x: x["nodes"])).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """``json`` -> batches."""
    outer = rows.select(F.posexplode(F.from_json("json", "array<array<int>>")).alias("batch_id", "nodes"))
    return outer.select("batch_id", F.posexplode("nodes").alias("pos", "node"))


def from_inline(rows: DataFrame) -> DataFrame:
    """``text`` like ``"0,1|2;3,4|5"`` -> ``set_id, batch_id, pos, node`` (; sets, | batches, , ids)."""
    sets = rows.select(F.posexplode(F.split("text", ";")).alias("set_id", "s"))
    parts = sets.select("set_id", F.posexplode(F.split("s", r"\|")).alias("batch_id", "b"))
    ids = parts.select("set_id", "batch_id", F.posexplode(F.split("b", ",")).alias("pos", "n"))
    return ids.where("trim(n) <> ''").select("set_id", "batch_id", "pos", F.trim("n").cast("int").alias("node"))
