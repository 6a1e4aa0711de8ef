"""Element-wise steps, checks and transforms of adjacency edge lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.frames import cells, magnitude, mirror, nodes_of, single_task, transpose  # noqa: F401

#: The size that a zero test of weights uses throughout.
TINY = 1e-6


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    """Overwrites the diagonal with ``fill``."""
    return remove_self_loops(edges).select("src", "dst", "w").union(identity(nodes, fill))


def identity(nodes: DataFrame, value: float = 1.0) -> DataFrame:
    return nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(float(value)).alias("w"))


def symmetrize(edges: DataFrame, how: str = "avg") -> DataFrame:
    """Each cell with its mirror image, the absent one as 0: ``avg``, ``max`` or ``min``."""
    if how not in ("avg", "max", "min"):
        raise ValueError(f"unknown way to symmetrize: {how}")
    both = edges.select("src", "dst", F.col("w").alias("a")).join(transpose(edges).withColumnRenamed("w", "b"), ["src", "dst"], "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    w = {"avg": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[how]
    return both.select("src", "dst", w.alias("w"))


def submatrix(edges: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells whose row is in ``rows(node)`` and whose column is in ``columns(node)``."""
    return edges.join(rows.select(F.col("node").alias("src")), "src", "left_semi").join(columns.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def upper_triangle(edges: DataFrame) -> DataFrame:
    return edges.where("src < dst")


def validate(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row ``(ok, message)``: the first of these that holds: a NaN, an infinity, a negative
    weight, (with ``nodes``) an end that is no node; else ok."""
    stray = F.lit(False)
    if nodes is not None:
        known = nodes.select(F.col("node").alias("_n"), F.lit(1).alias("_k"))
        edges = edges.join(known, edges["src"] == F.col("_n"), "left").drop("_n").withColumnRenamed("_k", "_ks").join(known, edges["dst"] == F.col("_n"), "left")
        stray = F.col("_ks").isNull() | F.col("_k").isNull()
    some = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    checks = edges.agg(some(F.isnan("w")).alias("nan"), some(F.abs("w") == float("inf")).alias("inf"), some((F.col("w") < 0) & ~F.isnan("w")).alias("neg"), some(stray).alias("stray"))
    message = F.when(F.col("nan"), "contains NaN").when(F.col("inf"), "contains infinite values").when(F.col("neg"), "contains negative weights").when(F.col("stray"), "contains unknown nodes").otherwise("valid")
    return checks.select((message == "valid").alias("ok"), message.alias("message"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, deg``: row sums, 0 for nodes without a row."""
    sums = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("deg", F.lit(0.0)).alias("deg"))


def degree_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return degrees(edges, nodes).select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("deg").alias("w"))


def inverse_degree_matrix(edges: DataFrame, nodes: DataFrame, power: float = -1.0, eps: float = 1e-10) -> DataFrame:
    return degree_matrix(edges, nodes).withColumn("w", F.pow(F.col("w") + F.lit(eps), F.lit(power)))


def _scaled(edges: DataFrame, nodes: DataFrame, row: float, column: float) -> DataFrame:
    """w * deg(src)^row * deg(dst)^column, a zero degree giving 0."""
    d = degrees(edges, nodes)
    factor = lambda p: F.when(F.col("deg") == 0, 0.0).otherwise(F.pow("deg", F.lit(p)))
    out = edges
    if row:
        out = out.join(d.select(F.col("node").alias("src"), factor(row).alias("f")), "src").withColumn("w", F.col("w") * F.col("f")).drop("f")
    if column:
        out = out.join(d.select(F.col("node").alias("dst"), factor(column).alias("f")), "dst").withColumn("w", F.col("w") * F.col("f")).drop("f")
    return out.select("src", "dst", "w")


def normalized_laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """I - D^-1/2 A D^-1/2; the diagonal of a node without weight stays 1."""
    minus = _scaled(edges, nodes, -0.5, -0.5).withColumn("w", -F.col("w"))
    return minus.union(identity(nodes)).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def largest_eigenvalue(edges: DataFrame, nodes: DataFrame) -> float:
    """Eigenvalue of the largest magnitude of a symmetric matrix."""
    import pandas as pd

    def kernel(m, ids):
        e = np.linalg.eigvalsh((m + m.T) / 2)
        return pd.DataFrame({"value": [float(e[np.abs(e).argmax()])]})

    return single_task(edges, nodes, kernel, "value double").first()[0]


def scaled_laplacian(edges: DataFrame, nodes: DataFrame, lambda_max: float | None = 2.0, undirected: bool = True) -> DataFrame:
    """(2 / lambda_max) L - I of the normalized Laplacian L of max(A, A')."""
    lap = normalized_laplacian(symmetrize(edges, "max") if undirected else edges, nodes)
    if lambda_max is None:
        lambda_max = largest_eigenvalue(lap, nodes)
    return lap.select("src", "dst", (F.col("w") * F.lit(2.0 / lambda_max) - F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)).alias("w"))


def message_passing(edges: DataFrame, nodes: DataFrame, variant: str = "as_computed") -> DataFrame:
    """With S = A + I: ``as_computed`` gives S' D^-1 (entry (i, j) = S[j, i] / deg(j)), which is what the
    formula in use comes to; ``documented`` gives D^-1/2 S D^-1/2."""
    s = edges.select("src", "dst", "w").union(identity(nodes)).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    if variant == "documented":
        return _scaled(s, nodes, -0.5, -0.5)
    if variant != "as_computed":
        raise ValueError(f"unknown variant: {variant}")
    return transpose(_scaled(s, nodes, -1.0, 0.0))


def transition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(D^-1 A)'."""
    return transpose(_scaled(edges, nodes, -1.0, 0.0))


def double_transition(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Transitions of A (dir 0) and of A' (dir 1)."""
    both = [transition(e, nodes).withColumn("dir", F.lit(i)) for i, e in enumerate((edges, transpose(edges)))]
    return both[0].union(both[1])


#: Adjacency types by name (fixed values, as settings have them); each takes (edges, nodes).
TRANSFORMS = {
    "original": lambda e, n: e,
    "scalap": scaled_laplacian,
    "normlap": normalized_laplacian,
    "symnadj": message_passing,
    "transition": transition,
    "doubletransition": double_transition,
    "identity": lambda e, n: identity(n),
}


def transform(edges: DataFrame, nodes: DataFrame, adj_type: str) -> DataFrame:
    if adj_type not in TRANSFORMS:
        raise ValueError(f"unknown adjacency type: {adj_type}")
    return TRANSFORMS[adj_type](edges, nodes)
