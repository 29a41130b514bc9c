"""Sums over all pairs by blocks of sources, against plain loops over dense matrices."""

import math

import numpy as np
import pytest

from wayfold.operators import allpairs, diagnostics, graphs, validation

N = 150


@pytest.fixture(scope="module")
def tables(spark):
    """A ring with chords, a separate edge beyond it, and two conditions: a node without coordinates, one outside the disk, two on one place."""
    edges = {(k, (k + 1) % N) for k in range(N)} | {(k, (k * k * 7 + 13) % N) for k in range(N)} | {(N, N + 1)}
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    rng = np.random.default_rng(3)
    at = {c: rng.uniform(-0.6, 0.6, (N + 2, 2)).tolist() for c in ("hydra_a", "mds_b")}
    at["mds_b"][5], at["mds_b"][9], at["mds_b"][20] = [None, 0.1], [1.5, 0.0], at["mds_b"][21]
    coords = [("g", c, k, *p) for c, ps in at.items() for k, p in enumerate(ps)]
    return spark.createDataFrame([("g", *e) for e in edges], "graph_id string, src long, dst long"), spark.createDataFrame(coords, "graph_id string, condition_id string, node long, x double, y double"), edges, at


def hops(edges):
    src, dst = np.array(edges).T
    return graphs.distances_of(N + 2, src, dst)


def pairs(edges, places, metric):
    """(g, h) of all unordered pairs with a path; h is None where it isn't known."""
    d, out = hops(edges), []
    for u in range(N + 2):
        for v in range(u + 1, N + 2):
            if d[u, v] < 0:
                continue
            (a, b), (x, y) = places[u], places[v]
            if None in (a, b, x, y) or (metric == "poincare" and max(math.hypot(a, b), math.hypot(x, y)) >= 1):
                out.append((int(d[u, v]), None))
                continue
            e = math.sqrt((a - x) ** 2 + (b - y) ** 2)
            out.append((int(d[u, v]), e if metric == "euclidean" else 2 * math.asinh(e / math.sqrt((1 - a * a - b * b) * (1 - x * x - y * y)))))
    return out


def midranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def test_distortions(spark, tables, monkeypatch):
    """With a task for each thousand or so sorted distances."""
    monkeypatch.setattr(allpairs, "SORTED", 1000)
    edges, coords, listed, at = tables
    relative = {(r.condition_id, r.metric): r for r in allpairs.distortion_relative(edges, coords).collect()}
    absolute = {(r.condition_id, r.metric): r for r in allpairs.distortion_absolute(edges, coords).collect()}
    assert len(relative) == len(absolute) == 4
    for key, r in relative.items():
        every = pairs(listed, at[key[0]], key[1])
        g, h = (np.array(x, float) for x in zip(*[p for p in every if p[1] is not None]))
        q = h / g
        alpha = q.sum() / (q @ q)
        assert tuple(r)[3:] == pytest.approx((alpha, np.abs(alpha * q - 1).mean(), math.sqrt(((alpha * q - 1) ** 2).mean())), rel=1e-10)
        alpha = g @ h / (h @ h)
        e = alpha * h - g
        # ranks of hops run over all pairs with a path, also those without a distance
        rg = midranks([p[0] for p in every])[[p[1] is not None for p in every]]
        stress = math.sqrt(e @ e / sum(p[0] ** 2 for p in every))
        want = (alpha, np.abs(e).mean(), math.sqrt((e * e).mean()), (np.abs(e) / g).mean(), stress, np.corrcoef(rg, midranks(h))[0, 1])
        assert tuple(absolute[key])[3:] == pytest.approx(want, rel=1e-10)


def test_strain(spark, tables):
    edges, coords, listed, at = tables
    d = hops(listed).astype(float)
    there = d >= 0
    mean = (d * d * there).sum(axis=1) / there.sum(axis=1)
    for r in allpairs.strain(edges, coords).collect():
        found, target, known = [], [], []
        for u, v in zip(*np.nonzero(there)):
            if r.condition_id == "hydra_a" and u >= v:
                continue
            (a, b), (x, y) = at[r.condition_id][u], at[r.condition_id][v]
            known.append(None not in (a, b, x, y))
            a, b, x, y = (w if w is not None else 0.0 for w in (a, b, x, y))
            hydra = r.condition_id == "hydra_a"
            found.append(1 + 2 * ((a - x) ** 2 + (b - y) ** 2) / ((1 - a * a - b * b) * (1 - x * x - y * y)) if hydra else a * x + b * y)
            target.append(math.cosh(d[u, v]) if hydra else -0.5 * (d[u, v] ** 2 - mean[u] - mean[v] + mean.mean()))
        found, target = np.array(found), np.array(target)
        missed = (found - target)[np.array(known)]
        assert (r.entries, r.strain) == (len(found), pytest.approx(math.sqrt(missed @ missed / (target @ target)), rel=1e-10))


def test_matrix_by_blocks(tables):
    """Blocks of 40 nodes give what the table of all pairs gives; the separate edge's pairs are missing."""
    edges = tables[0]
    (r,) = allpairs.matrix_violations(edges, side=40).collect()
    (want,) = diagnostics.matrix_violations(graphs.all_pairs(edges)).collect()
    assert tuple(r) == tuple(want) and r.missing == 4 * N


def test_single_searches(spark, tables):
    edges, _, listed, _ = tables
    d = hops(listed)
    wanted = spark.createDataFrame([("g", s, t) for s in (0, 7, N, N + 1) for t in (0, 1, 80, N, N + 1, N + 9)] + [("g", N + 9, 0), ("none", 0, 1)], "graph_id string, source long, destination long")
    got = {(r.graph_id, r.u, r.v): r.d for r in graphs.single_searches(edges, wanted).collect()}
    assert got == {("g", s, t): d[s, t] for s in (0, 7, N, N + 1) for t in (0, 1, 80, N, N + 1) if d[s, t] >= 0}
    lengths = spark.createDataFrame([("g", 0, 0, 80, int(d[0, 80])), ("g", 1, 7, 1, int(d[7, 1]) + 1), ("g", 2, 0, N, None)], "graph_id string, pair_index int, source long, destination long, shortest int")
    both = lengths.selectExpr("graph_id", "source", "destination").unionByName(lengths.selectExpr("graph_id", "destination as source", "source as destination"))
    (r,) = validation.length_mismatches(lengths, graphs.single_searches(edges, both)).collect()
    assert (r.pairs, r.mismatches) == (3, 1)


def test_change_over_parts(spark):
    """Enough nodes for several blocks; each part's sums and maxima come together."""
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-0.5, 0.5, (2, 150, 2))
    table = lambda p, more="": spark.createDataFrame([("g", "f", k, *map(float, xy), *(("c", 1.5) if more else ())) for k, xy in enumerate(p)], "graph_id string, family string, node long, x double, y double" + more)
    (r,) = diagnostics.distance_change(table(a), table(b, ", condition_id string, scale double")).collect()
    u, v = np.triu_indices(150, 1)
    e0, e1 = (np.linalg.norm(p[u] - p[v], axis=1) for p in (a, b))
    p0, p1 = (2 * np.arcsinh(e / np.sqrt((1 - (p[u] ** 2).sum(axis=1)) * (1 - (p[v] ** 2).sum(axis=1)))) for e, p in ((e0, a), (e1, b)))
    want = (len(u), 0, e0.mean(), e1.mean(), np.abs(e1 - e0).mean(), np.abs(e1 - 1.5 * e0).max(), p0.mean(), p1.mean(), np.abs(p1 - p0).mean(), np.abs(p1 - p0).max())
    assert tuple(r)[2:] == pytest.approx(want, rel=1e-10)


def test_search_by_columns(monkeypatch):
    """Hubs beyond the columns, nodes without edges, separate parts and long paths: what one search from each source finds."""
    monkeypatch.setattr(graphs.Search, "HUB", 3)
    star = [(0, k) for k in range(1, 40)] + [(k, k + 1) for k in range(50, 250)] + [(7, 45)]
    src, dst = np.array(star).T
    want = graphs.distances_of(260, src, dst)
    for sources in (np.arange(260), np.array([5, 255, 60]), np.arange(64)):
        found = graphs.Search(*graphs.neighbour_lists(260, src, dst)).columns_of(sources)
        assert found.dtype == (np.int8 if len(sources) == 64 and want[sources].max() < 128 else np.int16) and (found.T == want[sources]).all()


@pytest.mark.parametrize("at_once", [100, 1 << 18])
def test_sorted_together_with_hops(monkeypatch, at_once):
    """In eight bytes, with equal distances and zeros over the borders of what is gone through at once; by order where the bits don't suffice."""
    monkeypatch.setattr(allpairs, "AT_ONCE", at_once)
    rng = np.random.default_rng(6)
    h, level = rng.choice(np.concatenate([[0.0], rng.uniform(1e-9, 9, 40)]), 5000), rng.integers(1, 200, 5000)
    for deepest, packed in ((5000, False), (12, True)):
        hops = np.minimum(level, deepest).astype(np.int16)
        held = allpairs.Sorted(len(h), deepest, float(h[h > 0].min().view(np.int64) >> allpairs.BIN), int(h.max().view(np.int64) >> allpairs.BIN))
        assert held.packed == packed
        for k in range(0, 5000, 700):
            held.add(h[k : k + 700], hops[k : k + 700])
        groups = list(held.groups())
        order = np.lexsort([hops, h])
        one, two = (np.concatenate(x) for x in zip(*groups))
        assert (one == h[order]).all() and (np.bincount(two) == np.bincount(hops)).all() and all(a[-1] != b[0] for (a, _), (b, _) in zip(groups, groups[1:]))
