"""From a panel to saved graphs and batches: repair, generate, fuse, sparsify, batch, write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.panels import repair_zero_variance, time_slice
from ..operators.batchers import BATCHERS
from ..operators.fusion import SNFDiffusion
from ..operators.generators import MutualInformation, Pearson
from ..operators.metrics import batch_colours, difference
from ..sources.datasets import load_batches, load_edges, save_batches, save_edges
from .construct import make_adjacency


def prepare(panel: DataFrame, path: str, steps: int = 1000, k_per_node: int = 5, batchers: tuple[str, ...] = ("k-hop", "greedy-cluster", "louvain")) -> dict[str, str]:
    """Writes Pearson, mutual information and fused graphs (top k per row, rows summing to 1) and their
    batches below ``path``; returns the paths by name."""
    head = time_slice(panel, 0, steps)
    pearson = Pearson(undefined="zero").generate(repair_zero_variance(head))
    mi = MutualInformation().generate(head)
    views = {"pearson": pearson, "mi": mi, "snf": SNFDiffusion().fuse([pearson, mi])}
    out = {}
    for name, matrix in views.items():
        graph = make_adjacency(matrix, 0, "top-k-row", "row-l1", mask_params={"k_per_node": k_per_node})
        save_edges(graph, at := f"{path}/{name}")
        out[name] = at
        saved = load_edges(panel.sparkSession, at)
        for b in batchers:
            save_batches(BATCHERS[b]().batch(saved), at := f"{path}/batches/{name}-{b}")
            out[f"{name}-{b}"] = at
    return out


def resources(spark, paths: dict[str, str]) -> dict[str, DataFrame]:
    """What ``prepare`` saved, for plots: graphs, node colours, and the differences from the first graph."""
    graphs = {k: load_edges(spark, p) for k, p in paths.items() if "/batches/" not in p}
    out: dict[str, DataFrame] = dict(graphs)
    first = next(iter(graphs))
    out |= {f"{k}-less-{first}": difference(g, graphs[first]) for k, g in graphs.items() if k != first}
    for k, p in paths.items():
        if "/batches/" in p:
            b = load_batches(spark, p)
            out[f"{k}-colours"] = batch_colours(b, b.select("node").distinct())
    return out
