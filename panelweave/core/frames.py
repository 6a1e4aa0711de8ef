"""Frames the engine works on, and the small moves between them.

panel(t, node, value)   one row per cell of one feature (feature picked by ``feature_slice``)
series(node, xs)        a node's values in the order of t
edges(src, dst, w)      a matrix in coordinate form; an absent row is 0
nodes(node)             0..N-1
mask(src, dst)          chosen cells
Columns beyond these are ignored. Nodes are INT, weights DOUBLE.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Nodes that a single-task kernel accepts: its dense matrix is 200 MB.
KERNEL_NODES = 5000
EDGES = "src int, dst int, w double"
NODES = "node int"


def series(panel: DataFrame) -> DataFrame:
    """Packs a panel: one row per node, values in the order of t."""
    return panel.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("xs"))


def nodes_of(panel_or_edges: DataFrame) -> DataFrame:
    """Distinct nodes of a panel or an edge list."""
    if "node" in panel_or_edges.columns:
        return panel_or_edges.select("node").distinct()
    return panel_or_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def mirror(upper: DataFrame) -> DataFrame:
    """Adds the lower triangle to an upper one."""
    return upper.union(transpose(upper.where("src <> dst")))


def dense(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All N x N cells, absent ones as 0 (the result is N x N by definition)."""
    grid = nodes.select(F.col("node").alias("src")).crossJoin(nodes.select(F.col("node").alias("dst")))
    return grid.join(edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"))


def check_nodes(edges: DataFrame, nodes: DataFrame) -> None:
    """Raises ValueError if a cell's row or column is not in ``nodes``, or a column is missing."""
    missing = {"src", "dst", "w"} - set(edges.columns)
    if missing:
        raise ValueError(f"a matrix needs src, dst and w; {', '.join(sorted(missing))} missing")
    strange = nodes_of(edges).join(nodes.select("node"), "node", "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"cells of nodes that are not in the matrix: {[r['node'] for r in strange]}")


def select_mask(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of ``edges`` that ``mask`` chooses."""
    return edges.join(mask.select("src", "dst"), ["src", "dst"], "left_semi")


def magnitude(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.abs("w").alias("w"))


def pairs(packed: DataFrame, ordered: bool = False, same: bool = False) -> DataFrame:
    """``src, dst, x, y`` for all pairs of packed series: i < j, or i <= j (``same``), or all i <> j
    (``ordered``). A pairwise similarity has N^2 cells, and so has this join; for short vectors."""
    a = packed.select(F.col("node").alias("src"), F.col("xs").alias("x"))
    b = packed.select(F.col("node").alias("dst"), F.col("xs").alias("y"))
    on = F.col("src") != F.col("dst") if ordered else (F.col("src") <= F.col("dst") if same else F.col("src") < F.col("dst"))
    return a.join(b, on)


#: Series of a block; two blocks meet in a task.
BLOCK = 64


def block_pairs(packed: DataFrame, kernel: Callable[[np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]], pd.DataFrame], schema: str, by: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """Runs ``kernel(nodes, series, other nodes, other series)`` for every pair of blocks of packed series.

    Nodes are dealt to blocks of about ``block`` (``BLOCK``; fewer, if there are few nodes, so that all cores have
    pairs to work on); each series is shuffled once per block, so N / ``block`` times, not N times. A block
    meets itself with the same arguments on either side. With ``by``, rows of each value of those columns
    are paired among themselves. Kernels get nodes in ascending order and see each unordered pair of nodes
    once, but within a block, where they see both orders and each node with itself."""
    count = packed.agg(F.count_distinct("node")).first()[0]
    cores = packed.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(count, max(-(-count // (block or BLOCK)), math.isqrt(8 * cores))))
    own = packed.withColumn("block", F.pmod(F.col("node"), F.lit(blocks)))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(*by, F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "xs")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        pdf = pdf.sort_values("node", kind="stable")
        sides = []
        for side in (p, q):
            rows = pdf[pdf["block"] == side]
            sides += [rows["node"].to_numpy(), [np.asarray(x, float) for x in rows["xs"]]]
        out = kernel(*sides)
        for name in by:
            out[name] = pdf[name].iloc[0]
        return out

    return dealt.groupBy(*by, "p", "q").applyInPandas(run, schema)


def single_task(edges: DataFrame, nodes: DataFrame | None, kernel: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Runs ``kernel(matrix, node_ids)`` over the dense matrix, in one task.

    For steps that are sequential or dense linear algebra by nature. Raises beyond
    ``KERNEL_NODES`` nodes, so that no task takes on an unbounded matrix, and for a cell whose row or
    column is not in ``nodes``."""
    tagged = edges.select(F.lit(0).alias("g"), "src", "dst", "w")
    checked = nodes is not None
    if checked:
        tagged = tagged.union(nodes.select(F.lit(0), F.col("node"), F.col("node"), F.lit(None).cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate((pdf["src"], pdf["dst"])).astype(np.int64))
        if len(ids) > KERNEL_NODES:
            raise ValueError(f"{len(ids)} nodes; this operator takes {KERNEL_NODES} at most")
        if checked and (strange := np.setdiff1d(ids, pdf.loc[pdf["w"].isna(), "src"])).size:
            raise ValueError(f"cells of nodes that are not in the matrix: {strange[:5].tolist()}")
        matrix = np.zeros((len(ids), len(ids)))
        pdf = pdf[pdf["w"].notna()].sort_values(["src", "dst"])
        matrix[np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])] = pdf["w"]
        return kernel(matrix, ids)

    return tagged.groupBy("g").applyInPandas(run, schema)


def cells(matrix: np.ndarray, ids: np.ndarray, keep: np.ndarray | None = None) -> pd.DataFrame:
    """Matrix cells as edges: those that ``keep`` marks, else the non-zero ones."""
    i, j = np.nonzero(matrix if keep is None else keep)
    return pd.DataFrame({"src": ids[i].astype(np.int32), "dst": ids[j].astype(np.int32), "w": matrix[i, j].astype(float)})


def matrix_frame(spark: SparkSession, rows: list[list[float]]) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of a small literal matrix."""
    n = len(rows)
    edges = spark.createDataFrame([(i, j, float(rows[i][j])) for i in range(n) for j in range(n) if rows[i][j]], EDGES)
    return edges, spark.createDataFrame([(i,) for i in range(n)], NODES)
