"""Queries against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from panelweave.plans import catalog

DATA = "/root/testdata/sf0.001"
#: A query of each family; the driver compares them all.
SOME = ["flagship_adjacency", "gen_mi_ksg", "mask_mst", "mask_threshold", "norm_row_softmax", "adj_scalap", "fuse_snf", "batch_overlapping", "metrics_degree", "compare_matrices", "plot_degree_histogram", "decompose", "forecast_eval_whole_matrix", "forecast_eval_node_batches"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalog.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    q = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in q.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
