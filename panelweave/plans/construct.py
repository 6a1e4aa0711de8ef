"""Adjacency construction: similarity -> masks -> diagonal -> normalizers, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.frames import magnitude, nodes_of, select_mask
from ..functions.adjacency import add_self_loops
from ..functions.normalize import NORMALIZERS, Normalizer
from ..operators.fusion import FUSERS
from ..operators.generators import Generator
from ..operators.sparsifiers import SPARSIFIERS, Sparsifier


def _list(x) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


class MatrixConstruction:
    """|w|, the cells that all masks choose (each made on the original matrix; without a mask all
    cells), the diagonal set to 1 if asked for (its N cells count against the budget), then the
    normalizers one after the other."""

    def __init__(self, sparsifiers: Sparsifier | list[Sparsifier] | None = None, normalizers: Normalizer | list[Normalizer] | None = None, fill_diag: bool = False):
        self.sparsifiers, self.normalizers, self.fill_diag = _list(sparsifiers), _list(normalizers), fill_diag

    def run(self, matrix: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
        nodes = nodes_of(matrix) if nodes is None else nodes
        if self.fill_diag and self.sparsifiers:
            k = max(0, k - nodes.count())
        out = magnitude(matrix)
        for s in self.sparsifiers:
            out = select_mask(out, s.mask(matrix, nodes, k))
        if self.fill_diag:
            out = add_self_loops(out, nodes, 1.0)
        for n in self.normalizers:
            out = n.normalize(out)
        return out.select("src", "dst", "w")


def _known(registry: dict, name: str, what: str):
    if name not in registry:
        raise ValueError(f"unknown {what}: {name}; known: {', '.join(sorted(registry))}")
    return registry[name]


def make_adjacency(matrix: DataFrame, k: int, mask_method: str | None = "top-k-row", norm_method: str | None = None, norm_strength: float = 1.0, mask_params: dict | None = None, fill_diag: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Names instead of objects; unknown ones raise ValueError."""
    mask = _known(SPARSIFIERS, mask_method, "mask")(**(mask_params or {})) if mask_method else None
    norm = _known(NORMALIZERS, norm_method, "normalizer")(norm_strength) if norm_method else None
    return MatrixConstruction(mask, norm, fill_diag).run(matrix, k, nodes)


def adjacency_from_generator(generator: Generator, panel: DataFrame, k: int, **options) -> DataFrame:
    return make_adjacency(generator.generate(panel), k, **options)


def make_hybrid_adjacency(matrices: list[DataFrame], k: int, fuse_method: str = "weighted-average", fuse_params: dict | None = None, **options) -> DataFrame:
    return make_adjacency(_known(FUSERS, fuse_method, "fuser")(**(fuse_params or {})).fuse(matrices), k, **options)


def top_k_adjacency(matrix: DataFrame, k: int, normalize: str | None = None, strength: float = 1.0, prior: DataFrame | None = None) -> DataFrame:
    """Per-row top k (or as many as ``prior`` has in the row), then a normalizer."""
    from ..operators.sparsifiers import NeighbourK, TopKRow

    mask = NeighbourK(prior) if prior is not None else TopKRow(k)
    return MatrixConstruction(mask, NORMALIZERS[normalize](strength) if normalize else None).run(matrix, k)
