"""Graph operators against NumPy on small random inputs: blocks, ranges and rounds are made small."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.core import frames
from panelweave.core.frames import matrix_frame
from panelweave.functions import adjacency, panels
from panelweave.operators import batchers, forecasting, fusion, generators, metrics, sparsifiers
from panelweave.sources import datasets


def dense(edges, n):
    out = np.zeros((n, n))
    for r in edges.collect():
        out[r["src"], r["dst"]] = np.nan if r["w"] is None else r["w"]
    return out


def panel_of(spark, x, missing=()):
    rows = [(t, i, float(x[t, i])) for t in range(len(x)) for i in range(x.shape[1]) if (t, i) not in missing]
    return spark.createDataFrame(rows, "t int, node int, value double")


def random_graph(seed, n, share):
    r = np.random.default_rng(seed)
    m = np.where(r.random((n, n)) < share, r.random((n, n)) + 0.1, 0.0)
    np.fill_diagonal(m, 0)
    return m


def test_pearson_in_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(generators, "STEPS", 16)
    monkeypatch.setattr(frames, "BLOCK", 4)
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 13)) * 10 ** r.integers(0, 5, 13) + 1e6
    x[:, 5] = 7.3
    missing = {(t, 2) for t in range(0, 50, 3)}
    got = dense(generators.Pearson().generate(panel_of(spark, x, missing)), 13)
    for i, j in permutations(range(13), 2):
        rows = [t for t in range(50) if (t, i) not in missing and (t, j) not in missing]
        assert np.isnan(got[i, j]) if 5 in (i, j) else got[i, j] == pytest.approx(np.corrcoef(x[rows, i], x[rows, j])[0, 1], abs=1e-9)
    assert np.isnan(got[5, 5]) and got[0, 0] == 1
    moments = generators.co_moments(panel_of(spark, x[:, :3])).where("src = 0 and dst = 1").first()
    assert moments["cov1"] == pytest.approx(np.cov(x[:, 0], x[:, 1])[0, 1]) and moments["sx"] == pytest.approx(x[:, 0].std())


def test_pairs_of_blocks_are_all_pairs(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(12, 20))
    got = dense(generators.DTW(window=3).generate(panel_of(spark, x)), 20)
    for i, j in combinations(range(20), 2):
        d = generators.banded_dtw(x[None, :, i], x[None, :, j], 3)[0]
        assert got[i, j] == got[j, i] == pytest.approx(1 / (1 + d))
    bounds = {(b["src"], b["dst"]): b["w"] for b in generators.lb_keogh(panel_of(spark, x), 3).collect()}
    limit = float(np.median(list(bounds.values())))
    pruned = dense(generators.DTW(window=3, pruning_threshold=limit).generate(panel_of(spark, x)), 20)
    for i, j in combinations(range(20), 2):
        assert pruned[i, j] == pytest.approx(1 / (1 + bounds[i, j]) if bounds[i, j] > limit else got[i, j])
    g = dense(generators.Granger(2).generate(panel_of(spark, r.normal(size=(40, 9)))), 9)
    assert (g + np.eye(9) > 0).all() and (np.diag(g) == 0).all()


@pytest.mark.parametrize("digits", [1, 12])
def test_mutual_information_with_ties(digits):
    r = np.random.default_rng(2)
    for n in (5, 30, 300):
        x, y = np.round(r.normal(size=n), digits), np.round(r.normal(size=n) + r.integers(0, 2) * 0.1, digits)
        dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
        eps = np.sort(np.maximum(dx, dy), 1)[:, 3]
        assert np.array_equal(generators.neighbour_distances(x, y, 3), eps)
        nx, ny = (np.maximum((d < eps[:, None]).sum(1) - 1, 0) for d in (dx, dy))
        assert np.array_equal(generators.within(x, eps), nx) and np.array_equal(generators.within(y, eps), ny)
        h = lambda m: sum(1 / i for i in range(1, m + 1))
        assert generators.mutual_information(x, y, 3) == pytest.approx(h(2) + h(n - 1) - np.mean([h(a) + h(b) for a, b in zip(nx, ny, strict=True)]))
    assert generators.mutual_information(np.zeros(3), np.zeros(3), 3) == 0.0


def test_encoder_is_a_dilated_convolution():
    g = generators.CosineOfEmbeddings(3, 4, seed=5)
    x, h = np.random.default_rng(0).normal(size=17), None
    for depth, (w, b) in enumerate(g.weights()):
        h, d = x[None, :] if h is None else h, 2**depth
        now = np.zeros((len(b), 17))
        for o in range(len(b)):
            for t in range(17):
                now[o, t] = max(0.0, b[o] + sum(w[o, c, k] * h[c, t + (k - 1) * d] for c in range(len(h)) for k in range(3) if 0 <= t + (k - 1) * d < 17))
        h = now
    assert np.allclose(generators.dilated_encoding(x, g.weights()), h.mean(1))


def test_rank_average_with_ties(spark):
    r = np.random.default_rng(3)
    views = [np.round(np.where(r.random((9, 9)) < 0.5, r.normal(size=(9, 9)), 0), 1) for _ in range(2)]
    frames_ = [matrix_frame(spark, v.tolist()) for v in views]
    total = sum(np.argsort(np.argsort(np.abs(v).ravel(), kind="stable"), kind="stable") for v in views).reshape(9, 9).astype(float)
    want = (total - total.min()) / (total.max() - total.min())
    for cuts in (2, 7, 64):
        assert np.allclose(dense(fusion.RankAverage(cuts).fuse([e for e, _ in frames_], frames_[0][1]), 9), want)


def test_reachability(spark):
    for seed, share in ((4, 0.06), (5, 0.12), (6, 0.3)):
        m = random_graph(seed, 16, share)
        reach = np.linalg.matrix_power((m > 0).astype(float) + np.eye(16), 16) > 0
        e, n = matrix_frame(spark, m.tolist())
        got = {r["node"]: r["component"] for r in metrics.strong_components(e, n).collect()}
        assert got == {i: int(np.flatnonzero(reach[i] & reach[:, i])[0]) for i in range(16)}
        assert metrics.is_connected(e, n).first()[0] == bool(reach[0].all())
        both = np.linalg.matrix_power(((m + m.T) > 0).astype(float) + np.eye(16), 16) > 0
        assert {r["node"]: r["component"] for r in metrics.components(e, n).collect()} == {i: int(np.flatnonzero(both[i])[0]) for i in range(16)}


def test_comparison_of_weighted_matrices(spark):
    r = np.random.default_rng(7)
    a, b = random_graph(8, 7, 0.5), np.where(r.random((7, 7)) < 0.5, r.normal(size=(7, 7)), 0)
    (x, n), (y, _) = matrix_frame(spark, a.tolist()), matrix_frame(spark, b.tolist())
    got = metrics.compare(x, y, n).first().asDict()
    assert got["out_degree_corr"] == pytest.approx(np.corrcoef(a.sum(1), b.sum(1))[0, 1]) and got["in_degree_corr"] == pytest.approx(np.corrcoef(a.sum(0), b.sum(0))[0, 1])
    ea, eb = int((a > 0).sum()), int((b > 0).sum())
    assert (got["num_nodes"], got["edge_difference"]) == (7, abs(ea - eb)) and got["avg_degree_a"] == pytest.approx(ea / 7) and got["avg_degree_b"] == pytest.approx(eb / 7)
    assert got["overlap"] == pytest.approx(((a > 0) & (b > 0)).sum() / ((a > 0) | (b > 0)).sum())
    none = metrics.compare(x.where("w < 0"), y.where("w < -9"), n).first().asDict()
    assert none["overlap"] == 1.0 and none["jaccard"] == 0.0
    s = metrics.compare_spectra(x, y, n).first().asDict()
    ev = lambda z: np.sort(np.linalg.eigvals(z).real)
    assert s["spectral_l2"] == pytest.approx(np.linalg.norm(ev(a) - ev(b))) and s["laplacian_l2"] == pytest.approx(np.linalg.norm(ev(np.diag(a.sum(1)) - a) - ev(np.diag(b.sum(1)) - b)))
    found = {(r["kind"], r["pos"]): r["value"] for r in metrics.spectra(x, n).collect()}
    assert [found["adjacency", i] for i in range(7)] == pytest.approx(ev(a)[::-1].tolist()) and [found["laplacian", i] for i in range(7)] == pytest.approx(ev(np.diag(a.sum(1)) - a).tolist())
    sym = np.maximum(a, a.T)
    d = sym.sum(1)
    lap = np.eye(7) - sym / np.sqrt(np.outer(d, d))
    assert np.allclose(dense(adjacency.scaled_laplacian(x, n, lambda_max=None), 7), 2 / np.linalg.eigvalsh(lap).max() * lap - np.eye(7))


def test_spanning_forest_of_many_parts(spark):
    r = np.random.default_rng(9)
    m = np.triu(np.where(r.random((40, 40)) < 0.2, np.round(r.random((40, 40)), 2), 0), 1)
    e, n = matrix_frame(spark, m.tolist())
    got = {(x["src"], x["dst"]) for x in sparsifiers.maximum_spanning_forest(e.repartition(7), n).collect()}
    parent, want = list(range(40)), set()

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for w, i, j in sorted(((m[i, j], i, j) for i, j in zip(*np.nonzero(m), strict=True)), reverse=True):
        if root(i) != root(j):
            parent[root(i)] = root(j)
            want.add((i, j))
    assert got == want


def test_resistance_scores(spark):
    m = random_graph(10, 8, 0.6)
    m = (m + m.T) / 2
    e, n = matrix_frame(spark, m.tolist())
    rows = sparsifiers.ResistanceSampling(directed=False, seed=2).sample(e, n, 2000).collect()
    lap = np.diag(m.sum(1)) - m
    score = {}
    for i, j in combinations(range(8), 2):
        if m[i, j]:
            v = np.zeros(8)
            v[i], v[j] = 1, -1
            score[i, j] = m[i, j] * (v @ np.linalg.lstsq(lap, v, rcond=None)[0])
    total = sum(score.values())
    assert sum(r["n"] for r in rows) == 2000
    for r in rows:
        assert r["p"] == pytest.approx(score[r["src"], r["dst"]] / total) and r["new_w"] == pytest.approx(r["n"] * m[r["src"], r["dst"]] / 2000 / r["p"])


def test_complete_linkage_and_balance(spark):
    m = random_graph(11, 12, 0.9)
    a = (m + m.T) / 2
    e, n = matrix_frame(spark, m.tolist())
    groups = [{i} for i in range(12)]
    while len(groups) > 4:
        far = lambda g, h: max(m.max() - a[i, j] for i in g for j in h)
        g, h = min(combinations(groups, 2), key=lambda p: far(*p))
        groups = [x for x in groups if x not in (g, h)] + [g | h]
    rows = batchers.CompleteLinkage(4).batch(e, n).toPandas()
    assert {frozenset(g["node"]) for _, g in rows.groupby("batch_id")} == {frozenset(g) for g in groups}
    _, v = np.linalg.eigh(np.diag(a.sum(1)) - a)
    f = v[:, 1] * np.sign(v[0, 1])
    rows = batchers.BalancedPartition(3).batch(e, n).toPandas().sort_values(["batch_id", "pos"])
    assert rows["node"].tolist() == np.argsort(f, kind="stable").tolist() and rows.groupby("batch_id").size().tolist() == [4, 4, 4]
    parts = batchers.Louvain().batch(e, n).toPandas().set_index("node")["batch_id"].reindex(range(12)).to_numpy()
    best = batchers.modularity(a, parts)
    # no node gains by moving to another community
    for i in range(12):
        for c in set(parts):
            moved = parts.copy()
            moved[i] = c
            assert batchers.modularity(a, moved) <= best + 1e-9


def test_nodes_are_checked(spark):
    e, n = matrix_frame(spark, [[0, 1, 0], [1, 0, 2], [0, 2, 0]])
    few = n.where("node < 2")
    for b in (batchers.KHop(1), batchers.GreedyCluster(2)):
        with pytest.raises(Exception, match="not in the matrix"):
            b.batch(e, few).collect()
    with pytest.raises(ValueError, match="not in the matrix"):
        fusion.WeightedAverage().fuse([e, e], few)
    with pytest.raises(ValueError, match="missing"):
        frames.check_nodes(e.drop("w"), n)


def test_small_sources(spark, tmp_path):
    e, n = matrix_frame(spark, [[0, 1, 0], [1, 0, 2], [0, 2, 0]])
    datasets.save_edges(e, f"file://{tmp_path}/adj")
    got, raw = datasets.load_adjacency(spark, f"file://{tmp_path}/adj", n, "transition")
    assert raw.count() == 4 and dense(got, 3)[0, 1] == pytest.approx(1 / 3)
    with pytest.raises(ValueError):
        datasets.load_adjacency(spark, f"file://{tmp_path}/adj", n, "nothing")
    assert forecasting.average_neighbours(e, n) == pytest.approx(4 / 3 + 1) and forecasting.average_neighbours(e, n.limit(0)) == 0.0
    assert datasets.output_dir("/x/", "d", "t") == "/x/d/t"
    p = datasets.sinusoidal_panel(spark, 3, 5, 2)
    assert panels.feature_slice(p, 1).count() == 15
    with pytest.raises(ValueError):
        panels.feature_slice(p, 2)
    same = datasets.gaussian_panel(spark, 2, 3, exact=True).orderBy("t", "node").select("value").collect()
    assert np.allclose([r[0] for r in same], np.random.RandomState(42).randn(3, 2, 1).astype(np.float32).ravel())
    assert panels.time_slice(p, 1, 3).agg(F.min("t"), F.max("t")).first() == (1, 2) and math.isclose(1.0, 1.0)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 1000])
def test_best_correlations_are_those_of_all_pairs(spark, monkeypatch, slice_bytes):
    """copies, scaled copies, a constant series, gaps and a NaN; ties go to the larger node; pairs aren't shuffled."""
    r = np.random.default_rng(5)
    x = r.normal(size=(12, 30))
    x[:, 7], x[:, 8], x[:, 9], x[:, 10] = x[:, 3], 3 * x[:, 3], -x[:, 3], 4.0
    x[:, 11], x[:, 12], x[4, 13] = 0.0, 0.0, np.nan
    x[2, 11], x[2, 12] = 5.0, 7.0
    gaps = {(1, 14), (5, 14), *((t, 15) for t in range(12) if t > 1), *((t, 16) for t in range(9))}
    there = np.ones(x.shape, bool)
    for t, node in gaps:
        there[t, node] = False
    want = {}
    for i, j in permutations(range(30), 2):
        both = there[:, i] & there[:, j] & ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        u, v = x[both, i], x[both, j]
        if len(u) > 1 and np.ptp(u) and np.ptp(v):
            want.setdefault(i, []).append((round(abs(float(np.corrcoef(u, v)[0, 1])), 11), j))
    want = {i: sorted(row)[::-1][:3] for i, row in want.items()}
    monkeypatch.setattr(generators, "co_moments", None)
    cells = generators.pearson_top(panel_of(spark, x, gaps), 3, slice_bytes)
    got = {}
    for c in cells.collect():
        got.setdefault(c["src"], []).append((round(abs(c["w"]), 11), c["dst"]))
    assert {i: sorted(row)[::-1][:3] for i, row in got.items()} == want
    assert generators.pearson_top(panel_of(spark, x[:, :2]).where("node > 5"), 3).isEmpty()
