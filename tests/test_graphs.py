"""Small matrices worked by hand, invariants, and the edge cases that the driver's tables lack."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.core.frames import matrix_frame, nodes_of, series
from panelweave.functions import adjacency, panels
from panelweave.functions.normalize import NORMALIZERS
from panelweave.operators import batchers, forecasting, fusion, generators, metrics, sparsifiers
from panelweave.operators.planarity import is_planar
from panelweave.plans import catalog
from panelweave.plans.construct import MatrixConstruction, make_adjacency, make_hybrid_adjacency


def dense(edges, n):
    m = np.zeros((n, n))
    for r in edges.collect():
        m[r["src"], r["dst"]] = np.nan if r["w"] is None else r["w"]
    return m


def pairs(mask):
    return {(r["src"], r["dst"]) for r in mask.select("src", "dst").collect()}


def panel_of(spark, x):
    t, n = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"t": t.ravel().astype("int32"), "node": n.ravel().astype("int32"), "value": x.ravel().astype(float)}))


X = np.random.default_rng(0).normal(size=(40, 4))
M = [[1, 0.9, -0.5, 0.1], [0.9, 1, 0.4, 0.3], [-0.5, 0.4, 1, 0.7], [0.1, 0.3, 0.7, 1]]


def test_pearson_and_constant_series(spark):
    x = np.column_stack([X[:, :3], np.full(40, 2.0)])
    got = dense(generators.Pearson().generate(panel_of(spark, x)), 4)
    assert np.allclose(got[:3, :3], np.corrcoef(x[:, :3].T), atol=1e-12)
    assert np.isnan(got[3]).all()
    assert dense(generators.Pearson("zero").generate(panel_of(spark, x)), 4)[3].tolist() == [0, 0, 0, 0]


def test_partial_correlation(spark):
    p = np.linalg.inv(np.cov(X.T))
    want = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
    np.fill_diagonal(want, 1)
    assert np.allclose(dense(generators.PartialCorrelation().generate(panel_of(spark, X)), 4), want)


def _dtw(x, y, w):
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(x) + 1):
        for j in range(max(1, i - w), min(len(y), i + w - 1) + 1):
            d[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return math.sqrt(d[-1, -1])


def test_dtw(spark):
    got = dense(generators.DTW(window=5).generate(panel_of(spark, X)), 4)
    for i, j in combinations(range(4), 2):
        assert got[i, j] == pytest.approx(1 / (1 + _dtw(X[:, i], X[:, j], 5))) == got[j, i]
    pruned = dense(generators.DTW(window=5, pruning_threshold=0.0).generate(panel_of(spark, X)), 4)
    assert (pruned >= got - 1e-12).all()


def test_granger_finds_the_cause(spark):
    r = np.random.default_rng(1)
    cause = r.normal(size=200)
    effect = np.concatenate(([0], cause[:-1])) + 0.1 * r.normal(size=200)
    got = dense(generators.Granger(2).generate(panel_of(spark, np.column_stack([cause, effect, np.ones(200)]))), 3)
    assert got[0, 1] > 1 - 1e-12 and got[1, 0] < got[0, 1] and (got[2] == 0).all() and (np.diag(got) == 0).all()
    assert generators.f_survival(3.0, 2, 2) == pytest.approx(1 / 4)
    assert generators.f_survival(1.0, 5, 5) == pytest.approx(0.5)


def test_mutual_information_against_numpy(spark):
    h = lambda n: sum(1 / m for m in range(1, n + 1))
    x, k = X[:25, :3], 3
    got = dense(generators.MutualInformation(k).generate(panel_of(spark, x)), 3)
    for i, j in combinations(range(3), 2):
        dx, dy = (np.abs(x[:, c][:, None] - x[:, c][None]) for c in (i, j))
        eps = np.sort(np.maximum(dx, dy), 1)[:, k]
        nx, ny = ((d < eps[:, None]).sum(1) - 1 for d in (dx, dy))
        assert got[i, j] == pytest.approx(h(k - 1) + h(24) - np.mean([h(a) + h(b) for a, b in zip(np.maximum(nx, 0), np.maximum(ny, 0), strict=True)]))


def test_embedding_cosine_is_seeded(spark):
    g = generators.CosineOfEmbeddings(4, 8, seed=3)
    a, b = (dense(g.generate(panel_of(spark, X)), 4) for _ in range(2))
    assert np.array_equal(a, b) and np.allclose(np.diag(a), 1) and (a <= 1 + 1e-9).all()


def test_masks_on_a_small_matrix(spark):
    e, n = matrix_frame(spark, M)
    assert pairs(sparsifiers.TopKRow(1).mask(e, n, 0)) == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert pairs(sparsifiers.TopKRow().mask(e, n, 4)) == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert pairs(sparsifiers.GlobalTopE(directed=False).mask(e, n, 3)) == {(0, 1), (1, 0), (2, 3), (3, 2), (0, 2), (2, 0)}
    tree = pairs(sparsifiers.MST().mask(e, n, 0))
    assert tree == {(0, 1), (1, 0), (2, 3), (3, 2), (0, 2), (2, 0)}
    assert len(pairs(sparsifiers.PMFG().mask(e, n, 0))) == 12
    assert pairs(sparsifiers.MutualKnn(1).mask(e, n, 0)) == {(0, 1), (1, 0), (2, 3), (3, 2)}
    applied = dense(sparsifiers.TopKRow(2).apply(e, 0), 4)
    assert applied[0, 2] == -0.5
    assert pairs(sparsifiers.DegreeGreedy(0.5).mask(e, n, 2)) == {(0, 1), (2, 3)}
    assert pairs(sparsifiers.DHondt(directed=False).mask(e, n, 1)) == {(1, 0), (0, 1)}
    for s in (sparsifiers.GlobalTopE(), sparsifiers.KnnWithBudget(), sparsifiers.SpectralProxy(), sparsifiers.DegreeGreedy(), sparsifiers.DHondt(), sparsifiers.ResistanceSampling()):
        assert pairs(s.mask(e, n, 0)) == set()
    assert len(pairs(sparsifiers.ThresholdBudget().mask(e, n, 100))) == 12
    sampled = pairs(sparsifiers.ResistanceSampling(seed=4).mask(e, n, 5))
    assert sampled == pairs(sparsifiers.ResistanceSampling(seed=4).mask(e, n, 5)) and 0 < len(sampled) <= 5


def test_ties_zero_and_tiny_matrices(spark):
    e, n = matrix_frame(spark, [[0, 0.5, 0.5, 0.5], [0.5, 0, 0, 0], [0.5, 0, 0, 0], [0.5, 0, 0, 0]])
    assert pairs(sparsifiers.TopKRow(2).mask(e, n, 0).where("src = 0")) == {(0, 3), (0, 2)}
    one = spark.createDataFrame([(0,)], "node int")
    none = spark.createDataFrame([], "src int, dst int, w double")
    assert dense(adjacency.add_self_loops(none, one), 1).tolist() == [[1.0]]
    assert pairs(sparsifiers.MST().mask(none, one, 3)) == set()
    assert metrics.edge_statistics(none, one).first().asDict() == {"n": 1, "edges": 0, "density": 0.0, "sparsity": 1.0, "strength": 0.0}


def test_planarity():
    k5, k33 = list(combinations(range(5), 2)), [(i, j) for i in range(3) for j in range(3, 6)]
    assert not is_planar(k5) and not is_planar(k33) and is_planar(k5[1:]) and is_planar(k33[1:])
    grid = [(6 * i + j, 6 * i + j + 1) for i in range(6) for j in range(5)] + [(6 * i + j, 6 * i + j + 6) for i in range(5) for j in range(6)]
    assert is_planar(grid)
    r = random.Random(2)
    for _ in range(20):
        n, faces, edges = r.randint(6, 20), [(0, 1, 2)] * 2, [(0, 1), (1, 2), (0, 2)]
        for v in range(3, n):
            a, b, c = faces.pop(r.randrange(len(faces)))
            edges += [(a, v), (b, v), (c, v)]
            faces += [(a, b, v), (b, c, v), (a, c, v)]
        assert is_planar(edges)
        extra = [p for p in combinations(range(n), 2) if p not in {tuple(sorted(e)) for e in edges}]
        assert not is_planar([*edges, r.choice(extra)])


def test_transforms_against_numpy(spark):
    a = np.array([[0, 2, 0, 1], [1, 0, 3, 0], [0, 0, 0, 0], [4, 0, 1, 0]], float)
    e, n = matrix_frame(spark, a.tolist())
    d = a.sum(1)
    inv = np.where(d > 0, 1 / np.where(d > 0, d, 1), 0)
    assert np.allclose(dense(adjacency.transition(e, n), 4), (inv[:, None] * a).T)
    half = np.sqrt(inv)
    assert np.allclose(dense(adjacency.normalized_laplacian(e, n), 4), np.eye(4) - half[:, None] * a * half)
    hat = a + np.eye(4)
    assert np.allclose(dense(adjacency.message_passing(e, n), 4), hat.T / hat.sum(1))
    s = np.maximum(a, a.T)
    h = 1 / np.sqrt(s.sum(1))
    lap = np.eye(4) - h[:, None] * s * h
    assert np.allclose(dense(adjacency.scaled_laplacian(e, n), 4), lap - np.eye(4))
    top = np.abs(np.linalg.eigvalsh(lap)).max()
    assert np.allclose(dense(adjacency.scaled_laplacian(e, n, None), 4), 2 / top * lap - np.eye(4))
    with pytest.raises(ValueError):
        adjacency.transform(e, n, "nothing")
    bad = spark.createDataFrame([(0, 1, float("nan")), (1, 0, -1.0)], "src int, dst int, w double")
    assert adjacency.validate(bad).first()["message"] == "contains NaN"


def test_normalizers(spark):
    a = np.array([[0, 2.0, -1.0], [0.5, 0, 0], [0, 0, 0]])
    e, _ = matrix_frame(spark, a.tolist())
    l1 = dense(NORMALIZERS["row-l1"](2.0).normalize(e), 3)
    assert np.allclose(np.abs(l1).sum(1), [2, 2, 0]) and l1[0, 2] < 0
    assert np.allclose(dense(NORMALIZERS["row-softmax"]().normalize(e), 3).sum(1), [1, 1, 0])
    assert dense(NORMALIZERS["softmax"]().normalize(e), 3).sum() == pytest.approx(1)
    assert dense(NORMALIZERS["row-minmax"]().normalize(e), 3).tolist() == [[0, 1, 0], [0.5, 0, 0], [0, 0, 0]]
    assert dense(NORMALIZERS["minmax"]().normalize(e), 3)[1, 0] == pytest.approx(0.5)
    assert dense(NORMALIZERS["make-1"]().normalize(e), 3).sum() == 3


def test_fusion(spark):
    r = np.random.default_rng(5)
    a, b = (np.abs(r.normal(size=(6, 6))) for _ in range(2))
    a, b = a + a.T, b + b.T
    (x, n), (y, _) = matrix_frame(spark, a.tolist()), matrix_frame(spark, b.tolist())
    assert np.allclose(dense(fusion.WeightedAverage([1, 3]).fuse([x, y]), 6), a / 4 + b * 3 / 4)
    assert np.allclose(dense(fusion.ElementWiseMax().fuse([x, y]), 6), np.maximum(a, b))
    one, two = (dense(fusion.SNFDiffusion(2, 3, method=m).fuse([x, y], n), 6) for m in ("kernel", "distributed"))
    assert np.allclose(one, two) and np.allclose(one, one.T)
    with pytest.raises(ValueError):
        fusion.ElementWiseMin().fuse([x])
    with pytest.raises(ValueError):
        make_hybrid_adjacency([x, y], 5, "nothing")


def test_construction(spark):
    e, n = matrix_frame(spark, M)
    got = dense(make_adjacency(e, 8, "top-k-row", "row-l1", fill_diag=True), 4)
    assert np.allclose(got.sum(1), 1) and (np.diag(got) > 0).all() and (got > 0).sum() == 8
    both = MatrixConstruction([sparsifiers.TopKRow(1), sparsifiers.MST()]).run(e, 0, n)
    assert {(r["src"], r["dst"]) for r in both.collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    with pytest.raises(ValueError):
        make_adjacency(e, 1, "nothing")


def test_batchers_cover_each_node_once(spark):
    r = np.random.default_rng(6)
    block = np.kron(np.eye(3), np.ones((5, 5))) + 0.01 * r.random((15, 15))
    np.fill_diagonal(block, 0)
    e, n = matrix_frame(spark, block.tolist())
    groups = {frozenset(range(5 * i, 5 * i + 5)) for i in range(3)}
    for b in (batchers.KHop(1, 4), batchers.GreedyCluster(5), batchers.Louvain(), batchers.CompleteLinkage(3), batchers.Spectral(3), batchers.BalancedPartition(3), batchers.DegreeAware(8, 0.5), batchers.FixedSize(4), batchers.GreedyModularity()):
        rows = b.batch(e, n).toPandas()
        assert sorted(rows["node"]) == list(range(15)), b
        if isinstance(b, (batchers.Louvain, batchers.CompleteLinkage, batchers.Spectral, batchers.GreedyModularity, batchers.GreedyCluster)):
            assert {frozenset(g["node"]) for _, g in rows.groupby("batch_id")} == groups, b
    over = batchers.Overlapping(0.2, 1).batch(e.where("w > 0.5"), n).toPandas()
    assert set(over["node"]) == set(range(15))
    json = batchers.as_json(batchers.FixedSize(4).batch(e, n))
    assert batchers.from_json(json).count() == 15


def test_metrics(spark):
    a = np.array([[0, 1, 0, 0], [1, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]], float)
    e, n = matrix_frame(spark, a.tolist())
    row = metrics.graph_metrics(e, n).first().asDict()
    assert row["edges"] == 4 and row["density"] == pytest.approx(4 / 12) and row["reciprocity"] == pytest.approx(1 / 4)
    assert row["clustering_coefficient"] == pytest.approx(np.trace(a @ a @ a) / 24)
    assert row["n_components"] == 2 and row["is_connected"] is False and row["min_degree"] == 0
    got = metrics.compare(e, e, n).first().asDict()
    assert got["jaccard"] == pytest.approx(1) and got["f1"] == 1 and got["pearson"] == pytest.approx(1) and got["l1_weighted"] == 0
    b = np.array([[0, 0.5, 0, 0], [0, 0, 1, 0], [0, 0, 0, 2], [0, 0, 0, 0]])
    f, _ = matrix_frame(spark, b.tolist())
    got = metrics.compare(e, f, n).first().asDict()
    assert got["pearson"] == pytest.approx(np.corrcoef(a.ravel(), b.ravel())[0, 1]) and got["frobenius"] == pytest.approx(np.linalg.norm(a - b))
    assert not metrics.is_connected(e, n).first()[0]
    parts = {r["node"]: r["component"] for r in metrics.components(e, n).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 3}


def test_zero_variance_repair(spark):
    x = np.column_stack([X[:, 0], np.full(40, 3.0)])
    p = panel_of(spark, x)
    assert [r["node"] for r in panels.zero_variance_nodes(p).collect()] == [1]
    fixed = panels.repair_zero_variance(p)
    assert panels.zero_variance_nodes(fixed, 1e-12).isEmpty()
    assert sorted(fixed.collect()) == sorted(panels.repair_zero_variance(p).collect())


def test_repaired_cells_are_judged_by_the_scale_of_the_noise(spark):
    """on a panel of large values the noise is more than 1."""
    cells = catalog.repaired(panel_of(spark, np.column_stack([1e6 * (2 + X[:, 0]), X[:, 1]])))
    assert {r["node"] for r in cells.collect()} == {0} and cells.count() == len(X)
    far = panels.repair_zero_variance(panel_of(spark, np.column_stack([1e6 * (2 + X[:, 0]), np.full(len(X), 5.0)]))).where("node = 1").collect()
    assert max(abs(r["value"] - 5) for r in far) > 1


def test_forecasts(spark):
    x = np.column_stack([np.arange(60.0), np.tile([1.0, 2.0, 3.0], 20)])
    p = panel_of(spark, x)
    out = forecasting.evaluate(p, "single_node", forecasting.last_value, 6, 3)
    row = out.where("node = 0").agg(F.avg(F.col("y_true") - F.col("y_pred")).alias("e")).first()
    assert row["e"] == pytest.approx(2.0)
    exact = forecasting.evaluate(p, "whole_matrix", forecasting.seasonal_naive(3), 6, 3).where("node = 1")
    assert forecasting.metrics(exact).first()["mae"] == 0
    assert forecasting.effective_context(12, "divided", 5) == 2 and forecasting.effective_context(2, "divided", 50) == 1
    assert forecasting.median_prediction(np.arange(12).reshape(1, 2, 3, 2)).tolist() == [[2, 3], [8, 9]]
    few = spark.createDataFrame([(0, 0, 0)], "batch_id int, pos int, node int")
    part = forecasting.evaluate(p, "node_batches", forecasting.last_value, 6, 3, batches=few)
    assert part.where("node = 1").agg(F.max("y_pred")).first()[0] == 0.0


def test_series_keep_order(spark):
    got = {r["node"]: r["xs"] for r in series(panel_of(spark, X)).collect()}
    assert np.allclose(got[2], X[:, 2])
    assert sorted(r["node"] for r in nodes_of(panel_of(spark, X)).collect()) == [0, 1, 2, 3]


def test_top_cosines_are_over_all_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    xs = r.normal(size=(330, 4)).astype(np.float32)
    xs[300:310] = xs[5]  # ties, and best partners beyond the first 300
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for x in catalog.QUERIES["gen_cosine_embeddings_top"](spark, str(tmp_path)).collect():
        got.setdefault(x["src"], {})[x["dst"]] = x["w"]
    x = xs.astype(float)
    u = x / (np.sqrt((x * x).sum(1)) + 1e-8)[:, None]
    w = np.abs(u @ u.T)
    for i in range(330):
        best = sorted((j for j in range(330) if j != i), key=lambda j: (-round(w[i, j], 12), -j))[:2]
        assert got[i] == pytest.approx({j: w[i, j] for j in best}, abs=1e-6)
    small = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:40])], "node int, xs array<double>")
    top = {(c["src"], c["dst"]): c["w"] for c in generators.cosine_top(small, 39, block=7).collect()}
    assert top == pytest.approx({(c["src"], c["dst"]): c["w"] for c in generators.cosine(small).where("src <> dst").collect()})


def test_standard_mutual_information_is_over_all_hours(spark, tmp_path):
    r = np.random.default_rng(4)
    hours, x = 90, r.normal(size=(3, 90))
    x[1, 60:] = x[0, 60:] + 0.1 * x[1, 60:]  # what is shared comes late
    rows = [(3600 * t, f"kind{i}", float(x[i, t])) for i in range(3) for t in range(hours)]
    events = spark.createDataFrame(rows, "s long, event_type string, value double").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(c["src"], c["dst"]): c["w"] for c in catalog.QUERIES["gen_mi_standard"](spark, str(tmp_path)).collect()}
    harmonic = np.concatenate(([0], np.cumsum(1 / np.arange(1, hours + 1))))
    z = x / x.std(1)[:, None]

    def brute(a, b):
        dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        eps = np.sort(np.maximum(dx, dy), axis=1)[:, 3][:, None]
        nx, ny = ((d < eps).sum(1) - 1 for d in (dx, dy))
        return max(0, harmonic[2] + harmonic[hours - 1] - (harmonic[np.maximum(nx, 0)] + harmonic[np.maximum(ny, 0)]).mean())

    want = {(i, j): brute(z[i], z[j]) for i in range(3) for j in range(3)}
    most = max(want.values())
    assert got == pytest.approx({(i, j): most if i == j else w for (i, j), w in want.items()}, abs=1e-5)
