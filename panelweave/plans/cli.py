"""Command line: ``python -m panelweave.plans.cli --panel P [--config C | flags]`` writes a summary."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators.batchers import from_inline
from ..operators.forecasting import run_experiment
from ..sources.datasets import ExperimentConfig, load_batches, load_edges, save_summary


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--panel", required=True, help="Parquet of t, node, value")
    p.add_argument("--config", help="YAML settings; other flags are then ignored")
    p.add_argument("--dataset", default="")
    p.add_argument("--model", default="last-value")
    p.add_argument("--horizons", type=int, nargs="+", default=[3, 6, 12])
    p.add_argument("--context-length", type=int, default=12)
    p.add_argument("--window-strategy", default="absolute")
    p.add_argument("--modes", nargs="+", default=["single_node"])
    p.add_argument("--adjacency-files", nargs="*", default=[])
    p.add_argument("--node-batches", help='sets inline, as "0,1|2;3,4|5"')
    p.add_argument("--node-batches-files", nargs="*", default=[])
    p.add_argument("--batch-sizes", type=int, nargs="*", default=[])
    p.add_argument("--test-ratio", type=float)
    p.add_argument("--num-runs", type=int, default=1)
    p.add_argument("--output-dir", default="results")
    return p


def config_from(args: argparse.Namespace) -> ExperimentConfig:
    if args.config:
        return ExperimentConfig.load(args.config)
    return ExperimentConfig(**{k: v for k, v in vars(args).items() if k not in ("panel", "config")})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = config_from(args)
    spark = SparkSession.builder.getOrCreate()
    panel = spark.read.parquet(args.panel)
    edges = {f: load_edges(spark, f) for f in config.adjacency_files}
    sets = {f: load_batches(spark, f) for f in config.node_batches_files}
    if config.node_batches:
        inline = from_inline(spark.createDataFrame([(config.node_batches,)], "text string"))
        for i in range(config.node_batches.count(";") + 1):
            sets[f"inline_{i}"] = inline.where(f"set_id = {i}").drop("set_id")
    save_summary(run_experiment(panel, config, edges, sets), config.output_dir)


if __name__ == "__main__":
    main()
