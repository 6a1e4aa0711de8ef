"""Forecast evaluation over rolling windows.

A forecaster is a function of one group's context: ``(context [V, T], horizon) -> [V, H]`` for V
variates. Modes differ in how nodes are grouped into variates; each (window, group) is one call, and
groups are dealt out over the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Forecaster = Callable[[np.ndarray, int], np.ndarray]


def last_value(context: np.ndarray, horizon: int) -> np.ndarray:
    return np.repeat(context[:, -1:], horizon, 1)


def window_mean(context: np.ndarray, horizon: int) -> np.ndarray:
    return np.repeat(context.mean(1, keepdims=True), horizon, 1)


def seasonal_naive(period: int) -> Forecaster:
    """The value one period (or the context's length, if shorter) before."""

    def forecast(context, horizon):
        p = min(period, context.shape[1])
        return np.tile(context[:, -p:], (1, -(-horizon // p)))[:, :horizon]

    return forecast


FORECASTERS: dict[str, Forecaster] = {"last-value": last_value, "window-mean": window_mean, "seasonal-naive": seasonal_naive(12)}


def median_prediction(quantiles: np.ndarray) -> np.ndarray:
    """The middle of three quantiles: index 1 of the axis before the last of a 4-, 3- or 2-dimensional
    output (batch, variate, quantile, step), first of the batch."""
    q = np.asarray(quantiles)
    if q.ndim == 4:
        return q[0, :, 1, :]
    if q.ndim == 3:
        return q[:, 1, :]
    return q[1:2, :] if q.ndim == 2 else q[None, :]


def test_start(steps: int, ratio: float = 0.2) -> int:
    return int(steps * (1 - ratio))


def origins(panel: DataFrame, context: int, horizon: int, ratio: float = 0.2) -> DataFrame:
    """``window, origin``: tumbling origins from the test part on, with a full context and target."""
    steps = (panel.agg(F.max("t")).first()[0] or 0) + 1
    spark = panel.sparkSession
    start = test_start(steps, ratio)
    rows = spark.range(start, max(start, steps - horizon), horizon).select(F.col("id").cast("int").alias("origin"))
    return rows.where(F.col("origin") >= context).select(((F.col("origin") - start) / horizon).cast("int").alias("window"), "origin")


def windows(panel: DataFrame, context: int, horizon: int, ratio: float = 0.2) -> DataFrame:
    """``window, node, step, value``: step < 0 is the context, from 0 on the target.

    A cell of the panel finds its windows by arithmetic on t (at most context / horizon + 2 of them);
    there is no range join."""
    o = origins(panel, context, horizon, ratio)
    first = o.agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"), F.min("window").alias("w0"))
    # origins o = lo + k h with o - context <= t < o + h
    k0 = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("lo") - horizon) / horizon) + 1)
    k1 = F.least((F.col("hi") - F.col("lo")) / horizon, F.floor((F.col("t") - F.col("lo") + context) / horizon))
    spread = panel.crossJoin(F.broadcast(first)).where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0.cast("int"), k1.cast("int"))))
    return spread.select((F.col("w0") + F.col("k")).cast("int").alias("window"), "node", (F.col("t") - F.col("lo") - F.col("k") * horizon).cast("int").alias("step"), F.col("value").cast("double").alias("value"))


def effective_context(base: int, strategy: str, series: float) -> int:
    """``absolute``: base; ``divided``: base shared by the series seen at once, 1 at least."""
    if strategy not in ("absolute", "divided"):
        raise ValueError(f"unknown strategy: {strategy}")
    return base if strategy == "absolute" else max(1, int(base // max(1, series)))


def average_neighbours(edges: DataFrame, nodes: DataFrame) -> float:
    """Mean number of non-zero cells per row, the node itself included."""
    others = edges.where("w <> 0 and src <> dst").count()
    n = nodes.count()
    return others / n + 1 if n else 0.0


def memberships(mode: str, nodes: DataFrame, edges: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """``grp, node, pos, keep``: which nodes a group sees, in what order, and of which it keeps the forecast."""
    if mode == "single_node":
        return nodes.select(F.col("node").alias("grp"), "node", F.lit(0).alias("pos"), F.lit(True).alias("keep"))
    if mode == "whole_matrix":
        return nodes.select(F.lit(0).alias("grp"), "node", F.col("node").alias("pos"), F.lit(True).alias("keep"))
    if mode == "adj_neighbour":
        own = nodes.select(F.col("node").alias("grp"), "node", F.lit(-1).alias("pos"), F.lit(True).alias("keep"))
        near = edges.where("w <> 0 and src <> dst").select(F.col("src").alias("grp"), F.col("dst").alias("node"), F.col("dst").alias("pos"), F.lit(False).alias("keep"))
        return own.union(near)
    if mode == "node_batches":
        return batches.select(F.col("batch_id").alias("grp"), "node", "pos", F.lit(True).alias("keep"))
    raise ValueError(f"unknown mode: {mode}")


def forecast(cells: DataFrame, groups: DataFrame, horizon: int, forecaster: Forecaster) -> DataFrame:
    """``window, node, step, y_pred`` from ``windows`` cells; a node in several groups has the forecast
    of the last one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.set_index(["pos", "node", "keep", "step"])["value"].unstack("step").sort_index()
        y = np.asarray(forecaster(wide.to_numpy(float), horizon), float)
        keep = wide.index.get_level_values("keep").to_numpy(bool)
        node = wide.index.get_level_values("node").to_numpy()[keep]
        y = y[keep]
        return pd.DataFrame({"window": pdf["window"].iloc[0], "grp": pdf["grp"].iloc[0], "node": np.repeat(node, horizon), "step": np.tile(np.arange(horizon), len(node)), "y_pred": y.ravel()})

    context = cells.where("step < 0").join(groups, "node").select("window", "grp", "node", "pos", "keep", "step", "value")
    out = context.groupBy("window", "grp").applyInPandas(run, "window int, grp int, node int, step int, y_pred double")
    return out.groupBy("window", "node", "step").agg(F.max_by("y_pred", "grp").alias("y_pred"))


def evaluate(panel: DataFrame, mode: str, forecaster: Forecaster, context: int = 12, horizon: int = 12, ratio: float = 0.2, edges: DataFrame | None = None, batches: DataFrame | None = None) -> DataFrame:
    """``window, node, step, y_true, y_pred``: one forecast for the longest horizon; shorter ones are
    slices of it. Nodes that no group covers are forecast as 0."""
    cells = windows(panel, context, horizon, ratio)
    nodes = panel.select("node").distinct()
    predicted = forecast(cells, memberships(mode, nodes, edges, batches), horizon, forecaster)
    truth = cells.where("step >= 0").withColumnRenamed("value", "y_true")
    return truth.join(predicted, ["window", "node", "step"], "left").select("window", "node", "step", "y_true", F.coalesce("y_pred", F.lit(0.0)).alias("y_pred"))


def _errors():
    e = F.col("y_true") - F.col("y_pred")
    return [F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.greatest("y_true", F.lit(1.0)) * 100).alias("mape")]


def metrics(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(*_errors())


def step_metrics(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("step").agg(*_errors())


def run_metrics(forecasts: DataFrame, horizons: list[int]) -> DataFrame:
    """``horizon`` and the mean over windows of each window's metrics, for each horizon."""
    each = forecasts.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where("step < horizon")
    per = each.groupBy("horizon", "window").agg(*_errors())
    return per.groupBy("horizon").agg(F.count("*").alias("num_eval_windows"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "mse", "mape")])


def run_experiment(panel: DataFrame, config, edges: dict[str, DataFrame] | None = None, batch_sets: dict[str, DataFrame] | None = None) -> DataFrame:
    """Summary rows of all modes and their configurations, runs and horizons, with the seconds per horizon."""
    import time
    from functools import reduce

    from .batchers import FixedSize

    nodes = panel.select("node").distinct()
    n = nodes.count()
    rows, longest = [], max(config.horizons)
    for mode in config.modes:
        configs: dict[str, dict] = {"default": {}}
        series = {"single_node": 1, "whole_matrix": n}.get(mode, 1)
        if mode == "adj_neighbour":
            configs = {k: {"edges": e} for k, e in (edges or {}).items()}
        elif mode == "node_batches":
            sized = {f"size_{s}": FixedSize(s).batch(panel, nodes) for s in config.batch_sizes}
            configs = {k: {"batches": b} for k, b in ((batch_sets or {}) | sized).items()}
        for name, extra in configs.items():
            if "edges" in extra:
                series = average_neighbours(extra["edges"], nodes)
            if "batches" in extra:
                series = extra["batches"].groupBy("batch_id").count().agg(F.avg("count")).first()[0] or 1
            context = effective_context(config.context_length, config.window_strategy, series)
            for run in range(config.num_runs):
                began = time.time()
                out = evaluate(panel, mode, FORECASTERS[config.model], context, longest, 0.2 if config.test_ratio is None else config.test_ratio, **extra)
                result = run_metrics(out, config.horizons).toPandas()
                seconds = (time.time() - began) / len(config.horizons)
                rows.append(panel.sparkSession.createDataFrame(result.assign(dataset=config.dataset, mode=mode, config_name=name, window_strategy=config.window_strategy, context_length=context, run=run, num_nodes=n, time_sec=seconds)))
    return reduce(DataFrame.unionByName, rows)
