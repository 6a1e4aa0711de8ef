"""Datasets on disk: descriptions, raw panels, adjacency lists, batches, results and configurations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.adjacency import transform
from ..functions.panels import gaussian, uniform
from ..operators.batchers import as_json, from_json

#: The fields of a dataset description, as existing desc.json files have them.
DESCRIPTION = (
    "name string, domain string, shape array<int>, feature_description array<string>, `frequency (minutes)` double, has_graph boolean, "
    "regular_settings struct<INPUT_LEN:int,OUTPUT_LEN:int,TRAIN_VAL_TEST_RATIO:array<double>,NORM_EACH_CHANNEL:boolean,RESCALE:boolean,METRICS:array<string>,NULL_VAL:double>"
)
DEFAULT_RATIO = [0.7, 0.1, 0.2]


def load_description(spark: SparkSession, folder: str) -> DataFrame | None:
    """``desc.json`` as one row; None if it is missing or malformed."""
    try:
        rows = spark.read.schema(DESCRIPTION).option("multiLine", True).json(f"{folder}/desc.json")
        return rows if rows.where("name is not null or shape is not null").limit(1).count() else None
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def describe(spark: SparkSession, folder: str) -> str:
    """A readable report of a description; missing entries read N/A."""
    rows = load_description(spark, folder)
    if rows is None:
        return f"no description in {folder}"
    d = rows.first().asDict(recursive=True)
    shape = d.get("shape") or []
    part = lambda i: shape[i] if i < len(shape) else None
    settings = d.get("regular_settings") or {}
    entries = {
        "Name": d.get("name"), "Domain": d.get("domain"), "Time steps": part(0), "Nodes": part(1), "Features": part(2),
        "Feature description": d.get("feature_description"), "Frequency (minutes)": d.get("frequency (minutes)"), "Has graph": d.get("has_graph"),
        **{k: settings.get(k) for k in ("INPUT_LEN", "OUTPUT_LEN", "TRAIN_VAL_TEST_RATIO", "NORM_EACH_CHANNEL", "RESCALE", "METRICS", "NULL_VAL")},
    }
    return "\n".join(f"{k}: {'N/A' if v is None else v}" for k, v in entries.items())


def load_panel(spark: SparkSession, folder: str, data_file: str = "data.dat") -> DataFrame | None:
    """``t, node, feature, value`` of a raw float32 file in C order, shaped by the description.

    Fixed-length records of one time step each are read in parallel; None without a description or
    file. Production panels are Parquet: ``spark.read.parquet``."""
    rows = load_description(spark, folder)
    if rows is None:
        return None
    shape = rows.first()["shape"]
    if not shape or len(shape) != 3:
        return None
    _, n, c = shape
    path = f"{folder}/{data_file}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    # RDD only as far as the fixed-length reader goes: it has no DataFrame counterpart
    records = spark.sparkContext.binaryRecords(path, 4 * n * c).zipWithIndex()
    steps = records.map(lambda r: (r[1], bytearray(r[0]))).toDF("t long, cells binary")

    def unpack(frames):
        node, feature = np.divmod(np.arange(n * c), c)
        for f in frames:
            for t, cells in zip(f["t"], f["cells"], strict=True):
                yield pd.DataFrame({"t": np.int32(t), "node": node.astype(np.int32), "feature": feature.astype(np.int32), "value": np.frombuffer(cells, "<f4").astype(np.float64)})

    return steps.mapInPandas(unpack, "t int, node int, feature int, value double")


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """An edge list ``src, dst, w`` from Parquet or CSV. (Pickled matrices are not read: unpickling runs
    code. Convert them once.)"""
    rows = spark.read.option("header", True).schema("src int, dst int, w double").csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    return rows.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("w").cast("double").alias("w"))


def save_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)


def load_adjacency(spark: SparkSession, path: str, nodes: DataFrame, adj_type: str = "original") -> tuple[DataFrame, DataFrame]:
    """The transformed adjacency and the raw one; an unknown type raises ValueError."""
    raw = load_edges(spark, path)
    return transform(raw, nodes, adj_type), raw


@dataclass
class Dataset:
    """What a folder has; parts that are missing are None."""

    description: DataFrame | None = None
    panel: DataFrame | None = None
    adjacency: DataFrame | None = None
    raw_adjacency: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def load_dataset(spark: SparkSession, folder: str, adj_file: str | None = None, adj_type: str = "original") -> Dataset:
    out = Dataset(load_description(spark, folder), load_panel(spark, folder))
    out.warnings += [f"no {k} in {folder}" for k in ("description", "panel") if getattr(out, k) is None]
    if adj_file and out.panel is not None:
        nodes = out.panel.select("node").distinct()
        out.adjacency, out.raw_adjacency = load_adjacency(spark, f"{folder}/{adj_file}", nodes, adj_type)
    return out


def gaussian_panel(spark: SparkSession, n_nodes: int = 10, n_timesteps: int = 100, n_features: int = 1, seed: int = 42, exact: bool = False) -> DataFrame:
    """Standard normal cells. ``exact`` draws them on the driver from NumPy's legacy generator, in the
    same order as ``np.random.seed(seed); randn(L, N, C)``; otherwise each task makes its own cells."""
    if exact:
        if n_nodes * n_timesteps * n_features > 10_000_000:
            raise ValueError("exact panels are made on the driver; 10 million cells at most")
        x = np.random.RandomState(seed).randn(n_timesteps, n_nodes, n_features).astype(np.float32)
        t, node, feature = (i.ravel().astype(np.int32) for i in np.indices(x.shape))
        return spark.createDataFrame(pd.DataFrame({"t": t, "node": node, "feature": feature, "value": x.ravel().astype(float)}))
    return _grid(spark, n_nodes, n_timesteps, n_features).withColumn("value", gaussian(F.lit(seed), F.col("t"), F.col("node"), F.col("feature")))


def _grid(spark, n_nodes, n_timesteps, n_features) -> DataFrame:
    every = spark.range(n_timesteps * n_nodes * n_features)
    at = lambda c: F.floor(c).cast("int")
    return every.select(at(F.col("id") / (n_nodes * n_features)).alias("t"), at(F.col("id") / n_features % n_nodes).alias("node"), (F.col("id") % n_features).cast("int").alias("feature"))


def sinusoidal_panel(spark: SparkSession, n_nodes: int = 10, n_timesteps: int = 200, n_features: int = 1, noise_level: float = 0.1, seed: int = 42) -> DataFrame:
    """sin(f t + p) with f = 1 + u / 2 and p = 2 pi u over t in [0, 10]; with three nodes or more, nodes 0
    to 2 are sin t, sin(t - 1/2) and the square of node 0; noise on all cells, features above 0 only
    noise."""
    grid = _grid(spark, n_nodes, n_timesteps, n_features)
    x = F.col("t") * F.lit(10.0 / max(1, n_timesteps - 1))
    u = lambda i: uniform(F.lit(seed), F.lit(i), F.col("node"))
    wave = F.sin((1 + u(1) / 2) * x + 2 * np.pi * u(2))
    if n_nodes >= 3:
        wave = F.when(F.col("node") == 0, F.sin(x)).when(F.col("node") == 1, F.sin(x - 0.5)).when(F.col("node") == 2, F.sin(x) * F.sin(x)).otherwise(wave)
    noise = F.lit(noise_level) * gaussian(F.lit(seed), F.col("t"), F.col("node"), F.col("feature"))
    return grid.withColumn("value", F.when(F.col("feature") == 0, wave).otherwise(0.0) + noise)


# ------------------------------------------------------------------ results


def output_dir(base: str, dataset: str, ts: str) -> str:
    return f"{base.rstrip('/')}/{dataset}/{ts}"


def save_forecasts(forecasts: DataFrame, path: str) -> None:
    """``mode, horizon, strategy, window, node, step, y_true, y_pred`` partitioned by the first three."""
    forecasts.write.mode("overwrite").partitionBy("mode", "horizon", "strategy").parquet(f"{path}/predictions")


def save_step_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/step_metrics")


def save_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/summary")


def save_batches(batches: DataFrame, path: str) -> None:
    as_json(batches).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def load_batches(spark: SparkSession, path: str) -> DataFrame:
    return from_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


#: Names of modes and strategies in existing settings and result files.
MODES = ("single_node", "whole_matrix", "adj_neighbour", "node_batches")
STRATEGIES = ("absolute", "divided")


@dataclass
class ExperimentConfig:
    """Settings of an evaluation; the defaults are those of a run without a file.

    Fixed values: the names of the settings and their defaults, as existing files have them."""

    dataset: str = ""
    model: str = "last-value"
    horizons: list[int] = field(default_factory=lambda: [3, 6, 12])
    context_length: int = 12
    window_strategy: str = "absolute"
    modes: list[str] = field(default_factory=lambda: ["single_node"])
    adjacency_files: list[str] = field(default_factory=list)
    node_batches: str | None = None
    node_batches_files: list[str] = field(default_factory=list)
    batch_sizes: list[int] = field(default_factory=list)
    test_ratio: float | None = None
    num_runs: int = 1
    output_dir: str = "results"

    def __post_init__(self):
        for mode in self.modes:
            if mode not in MODES:
                raise ValueError(f"unknown mode: {mode}")
        if self.window_strategy not in STRATEGIES:
            raise ValueError(f"unknown window strategy: {self.window_strategy}")
        if "adj_neighbour" in self.modes and not self.adjacency_files:
            raise ValueError("adj_neighbour needs adjacency_files")

    @classmethod
    def load(cls, path: str) -> ExperimentConfig:
        """From YAML (or JSON); entries that aren't settings raise TypeError."""
        text = Path(path).read_text()
        try:
            import yaml

            return cls(**(yaml.safe_load(text) or {}))
        except ImportError:
            return cls(**json.loads(text))

    def save(self, path: str) -> None:
        """A snapshot beside the results."""
        try:
            import yaml

            Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False))
        except ImportError:
            Path(path).write_text(json.dumps(asdict(self), indent=1))
