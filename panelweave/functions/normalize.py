"""Normalizers of sparse matrices: each maps edges to edges of the same cells."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-6


class Normalizer(ABC):
    """``strength`` multiplies the result of those normalizers that use it."""

    def __init__(self, strength: float = 1.0):
        self.strength = float(strength)

    @abstractmethod
    def normalize(self, edges: DataFrame) -> DataFrame: ...

    __call__ = lambda self, edges: self.normalize(edges)

    def _with(self, edges: DataFrame, w: Column) -> DataFrame:
        return edges.select("src", "dst", w.alias("w"))


def _set() -> Column:
    return F.abs("w") >= TINY


def _row():
    return Window.partitionBy("src")


def _global(edges: DataFrame, **aggregates: Column) -> DataFrame:
    """Adds whole-matrix aggregates: one row, made with a partial sum per task, beside each edge."""
    return edges.crossJoin(F.broadcast(edges.agg(*[c.alias(k) for k, c in aggregates.items()])))


class RowL1(Normalizer):
    """strength * w / sum |w| of the row; a row without weight stays 0."""

    def normalize(self, edges):
        total = F.sum(F.abs("w")).over(_row())
        return self._with(edges, F.lit(self.strength) * F.col("w") / F.when(total == 0, 1.0).otherwise(total))


class RowSoftmax(Normalizer):
    """strength * e^w / sum e^w over the row's non-zero cells; zeros stay 0."""

    def normalize(self, edges):
        e = F.when(_set(), F.exp("w"))
        return self._with(edges, F.coalesce(F.lit(self.strength) * e / F.sum(e).over(_row()), F.lit(0.0)))


class GlobalSoftmax(Normalizer):
    def normalize(self, edges):
        e = F.when(_set(), F.exp("w"))
        return self._with(_global(edges, total=F.sum(e)), F.coalesce(F.lit(self.strength) * e / F.col("total"), F.lit(0.0)))


def _min_max(low: Column, high: Column, flat: Column) -> Column:
    return F.when(_set(), F.when(flat, F.col("w")).otherwise((F.col("w") - low) / F.when(flat, 1.0).otherwise(high - low))).otherwise(F.col("w"))


class RowMinMax(Normalizer):
    """(w - min) / (max - min) over the row's non-zero cells, unchanged where max - min <= 1e-6; the
    least cell becomes an explicit 0."""

    def normalize(self, edges):
        w = F.when(_set(), F.col("w"))
        low, high = F.min(w).over(_row()), F.max(w).over(_row())
        return self._with(edges, _min_max(low, high, high - low <= TINY))


class GlobalMinMax(Normalizer):
    def normalize(self, edges):
        w = F.when(_set(), F.col("w"))
        return self._with(_global(edges, low=F.min(w), high=F.max(w)), _min_max(F.col("low"), F.col("high"), F.col("high") - F.col("low") < TINY))


class Binary(Normalizer):
    """1 where |w| > 1e-6, else 0."""

    def normalize(self, edges):
        return self._with(edges, F.when(F.abs("w") > TINY, 1.0).otherwise(0.0))


NORMALIZERS: dict[str, type[Normalizer]] = {"row-l1": RowL1, "row-softmax": RowSoftmax, "softmax": GlobalSoftmax, "row-minmax": RowMinMax, "minmax": GlobalMinMax, "make-1": Binary}
