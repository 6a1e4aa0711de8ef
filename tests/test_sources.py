"""Datasets, results and settings on disk."""

import json

import numpy as np
import pytest

from panelweave.plans import cli
from panelweave.plans.prepare import prepare, resources
from panelweave.sources import datasets
from panelweave.streaming.panel import panel_cells


def test_raw_panel_and_description(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(7, 3, 2)).astype("<f4")
    x.tofile(tmp_path / "data.dat")
    (tmp_path / "desc.json").write_text(json.dumps({"name": "x", "shape": [7, 3, 2]}, indent=1))
    got = datasets.load_dataset(spark, str(tmp_path)).panel.toPandas().sort_values(["t", "node", "feature"])
    assert np.allclose(got["value"], x.ravel())
    text = datasets.describe(spark, str(tmp_path))
    assert "Nodes: 3" in text and "Domain: N/A" in text
    assert datasets.load_dataset(spark, str(tmp_path / "none")).panel is None


def test_synthetic_panels(spark):
    g = datasets.gaussian_panel(spark, 3, 5, 1, seed=1, exact=True).toPandas().sort_values(["t", "node"])
    assert np.allclose(g["value"], np.random.RandomState(1).randn(5, 3, 1).astype(np.float32).ravel())
    s = datasets.sinusoidal_panel(spark, 3, 50, noise_level=0.0).toPandas().pivot(index="t", columns="node", values="value").to_numpy()
    t = np.linspace(0, 10, 50)
    assert np.allclose(s, np.column_stack([np.sin(t), np.sin(t - 0.5), np.sin(t) ** 2]))


def test_prepare_saves_and_reloads(spark, tmp_path):
    panel = datasets.sinusoidal_panel(spark, 5, 40).select("t", "node", "value")
    paths = prepare(panel, str(tmp_path), k_per_node=2, batchers=("greedy-cluster",))
    found = resources(spark, paths)
    assert found["snf"].count() == 10 and found["pearson-greedy-cluster-colours"].count() == 5


def test_settings(tmp_path):
    config = cli.config_from(cli.parser().parse_args(["--panel", "p", "--modes", "node_batches", "--batch-sizes", "2", "3"]))
    assert config.batch_sizes == [2, 3]
    config.save(str(tmp_path / "c.yaml"))
    assert datasets.ExperimentConfig.load(str(tmp_path / "c.yaml")) == config
    for wrong in ({"modes": ["x"]}, {"window_strategy": "x"}, {"modes": ["adj_neighbour"]}):
        with pytest.raises(ValueError):
            datasets.ExperimentConfig(**wrong)


def test_experiment_from_the_command_line(spark, tmp_path):
    datasets.sinusoidal_panel(spark, 4, 80).select("t", "node", "value").write.parquet(str(tmp_path / "panel"))
    cli.main(["--panel", str(tmp_path / "panel"), "--horizons", "3", "--modes", "single_node", "node_batches", "--node-batches", "0,1|2,3", "--output-dir", str(tmp_path / "out")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "summary")).collect()
    assert {r["mode"] for r in rows} == {"single_node", "node_batches"} and all(float(r["mae"]) > 0 for r in rows)


def test_streaming_panel(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1 as node, 2.0D as value union all select timestamp'2024-01-01 00:50:00', 1, 3.0D union all select timestamp'2024-01-01 05:00:00', 1, 1.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = panel_cells(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cells").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["value"] for r in spark.sql("select * from cells order by start").collect()] == [5.0]
