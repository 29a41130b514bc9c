"""Engine operators on hand-computed graphs, and against independent state machines."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import embedding, estimands, graphs, inference, routing, sampling, validation, walking
from wayfold.plans import queries


def edge_table(spark, **named):
    return spark.createDataFrame([(g, min(e), max(e)) for g, es in named.items() for e in es], "graph_id string, src long, dst long")


def coord_table(spark, **named):
    return spark.createDataFrame([(g, "c", k, float(x), float(y)) for g, ps in named.items() for k, (x, y) in enumerate(ps)], "graph_id string, condition_id string, node long, x double, y double")


def test_structure(spark):
    edges = edge_table(spark, path=[(0, 1), (1, 2), (2, 3)], tri=[(0, 1), (1, 2), (0, 2)])
    rows = {r.graph_id: r for r in graphs.network_metrics(edges).collect()}
    p, t = rows["path"], rows["tri"]
    assert (p.n, p.m, p.average_degree, p.maximum_degree, p.population_degree_variance, p.average_clustering_coefficient, p.diameter) == (4, 3, 1.5, 2, 0.25, 0, 3)
    assert p.average_shortest_path_length == pytest.approx(10 / 6) and (t.average_clustering_coefficient, t.diameter) == (1, 1)
    levels = graphs.bfs(edges, spark.createDataFrame([("path", 0)], "graph_id string, source long")).collect()
    assert sorted((r.node, r.d) for r in levels) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert {r.graph_id: r.connected for r in graphs.is_connected(edge_table(spark, a=[(0, 1)], b=[(0, 1), (2, 3)])).collect()} == {"a": True, "b": False}
    loops = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 1, 2)], "graph_id string, src long, dst long")
    assert [tuple(r) for r in graphs.canonical_edges(loops).collect()] == [("a", 1, 2)]


def test_distances(spark):
    near = spark.createDataFrame([(0.3, 0.2, 0.3 + 1e-12, 0.2), (0.0, 0.0, 1e-200, 0.0), (0.0, 0.0, 0.5, 0.0), (1.0, 0.0, 0.0, 0.0)], "ux double, uy double, vx double, vy double")
    d = [r[0] for r in near.select(geometry.poincare(F.col("ux"), F.col("uy"), F.col("vx"), F.col("vy"))).collect()]
    assert d[0] > 0 and d[1] / 1e-200 == pytest.approx(2, rel=1e-14) and d[2] == pytest.approx(2 * math.atanh(0.5)) and d[3] is None


def route(spark, edges, coords, pairs, metric="euclidean", protocol="i1", tolerance=1e-12, repair=False):
    table = spark.createDataFrame([("g", k, s, t) for k, (s, t) in enumerate(pairs)], "graph_id string, pair_index int, source long, destination long")
    goal = table.select("graph_id", F.lit("c").alias("condition_id"), F.lit(metric).alias("metric"), F.lit(tolerance).alias("tolerance"), "destination")
    plain = routing.routes(table, routing.decisions(graphs.adjacency(edge_table(spark, g=edges)), coord_table(spark, g=coords), goal, protocol), 50, protocol)
    out = routing.repaired(plain, 50, protocol) if repair else plain
    return sorted(out.drop("by_node").collect(), key=lambda r: r.pair_index)


def test_ties_and_adjacency(spark):
    (r,) = route(spark, [(0, 1), (0, 2), (1, 3), (2, 3)], [(0, 0.8), (-0.2, 0), (0.2, 0), (0, 0)], [(0, 3)])
    assert r.walk == [0, 1, 3] and r.success and r.decisions == 2
    (r,) = route(spark, [(0, 1), (0, 2), (1, 2)], [(-0.5, 0), (0.5, 0), (0.5, 0)], [(0, 2)], protocol="i2")
    assert r.walk == [0, 2] and r.success
    (r,) = route(spark, [(0, 1), (1, 2), (2, 3)], [(-0.8, 0), (-0.2, 0), (-0.9, 0), (0.8, 0)], [(0, 3)])
    assert r.walk == [0, 1] and r.failure == "attempted_revisit"


def test_repair(spark):
    edges, coords = [(0, 1), (1, 2), (1, 3), (3, 4)], [(-0.8, 0), (-0.2, 0), (0.65, 0), (-0.5, 0.4), (0.85, 0)]
    for protocol in ("i1", "i2"):
        (r,) = route(spark, edges, coords, [(0, 4)], "poincare", protocol, repair=True)
        assert r.walk == [0, 1, 2, 1, 3, 4] and r.hops == 5 and r.success and r.attempted and r.alternative_existed
        assert r.initial_failure == ("local_minimum" if protocol == "i2" else "attempted_revisit")
    (r,) = route(spark, [(0, 1), (1, 2)], [(0.1, 0), (0.5, 0), (0, 0)], [(0, 2)], "poincare", "i2", repair=True)
    assert r.final_failure == "repair_unavailable_at_source" and r.hops == 0 and not r.attempted


def walked(adj, xy, s, t, metric, tol, protocol):
    """An independent state machine; ties go to the smallest node."""
    def d(a):
        (x, y), (u, v) = xy[a], xy[t]
        e = math.hypot(x - u, y - v)
        return e if metric == "euclidean" else 2 * math.asinh(e / math.sqrt((1 - x * x - y * y) * (1 - u * u - v * v)))

    walk = [s]
    while walk[-1] != t:
        cur = walk[-1]
        if protocol == "i2" and t in adj[cur]:
            walk.append(t)
            continue
        low = min(d(k) for k in adj[cur])
        if protocol == "i2":
            if not low < d(cur) - tol:
                return walk, "local_minimum"
            walk.append(min(k for k in adj[cur] if d(k) <= low + tol and d(k) < d(cur) - tol))
            continue
        best = min(k for k in adj[cur] if d(k) <= low + tol)
        if best in walk:
            return walk, "attempted_revisit"
        if not d(best) < d(cur) - tol:
            return walk, "local_minimum"
        walk.append(best)
    return walk, None


@pytest.mark.parametrize("protocol", ["i1", "i2"])
def test_routes_match_state_machine(spark, protocol):
    rng = random.Random(3)
    edges = graphs.barabasi_albert(40, 2, 5).tolist()
    xy = [(rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for _ in range(40)]
    adj = {k: set() for k in range(40)}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    pairs = [(s, t) for s in range(0, 40, 3) for t in range(1, 40, 5) if s != t]
    for metric in ("euclidean", "poincare"):
        for r, (s, t) in zip(route(spark, edges, xy, pairs, metric, protocol), pairs):
            assert (r.walk, r.failure) == walked(adj, xy, s, t, metric, 1e-12, protocol)


def walk_all(spark, edges, coords, pairs, protocol):
    table = spark.createDataFrame([("g", k, s, t) for k, (s, t) in enumerate(pairs)], "graph_id string, pair_index int, source long, destination long")
    return walking.walks(table, graphs.adjacency(edge_table(spark, g=edges)), coord_table(spark, g=coords), protocol)


@pytest.mark.parametrize("protocol", ["i1", "i2"])
def test_walks_match_decision_table(spark, protocol):
    rng = random.Random(4)
    edges = graphs.barabasi_albert(40, 2, 5).tolist()
    xy = [(rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for _ in range(40)]
    pairs = [(s, t) for s in range(0, 40, 3) for t in range(1, 40, 5) if s != t]
    walked = walk_all(spark, edges, xy, pairs, protocol).cache()
    counted = ["decisions"] if protocol == "i1" else []
    for metric in ("euclidean", "poincare"):
        for repair, own in ((False, walking.ordinary(walked)), (True, walking.repaired(walked))):
            mine = sorted(own.where(F.col("metric") == metric).collect(), key=lambda r: r.pair_index)
            keep = [c for c in own.columns if c not in ("decisions",)] + counted
            assert [[r[c] for c in keep] for r in mine] == [[r[c] for c in keep] for r in route(spark, edges, xy, pairs, metric, protocol, repair=repair)]


def test_keyed_ties(spark):
    edges, xy = [(0, 1), (0, 2), (1, 3), (2, 3)], [(-0.5, 0), (0, 0.2), (0, -0.2), (0.5, 0)]
    for order in (edges, edges[::-1]):
        rows = walking.ordinary(walk_all(spark, order, xy, [(0, 3)] * 40, "i2")).collect()
        for r in rows:
            rank = walking.priority(walking.priority_key("g", ""), "g", r.pair_index, 0, 3)
            assert r.walk == [0, min((1, 2), key=lambda k: rank(0, k)), 3] and r.success
        assert {r.walk[1] for r in rows} == {1, 2}
    # repair: back to 0, whose tied alternatives are 2 and 3
    edges, xy = [(0, 4), (4, 1), (4, 2), (4, 3), (2, 5), (3, 5)], [(-0.8, 0), (0.3, 0), (-0.2, 0.3), (-0.2, -0.3), (-0.5, 0), (0.8, 0)]
    rows = walking.repaired(walk_all(spark, edges, xy, [(0, 5)] * 40, "i2")).collect()
    assert {tuple(r.walk) for r in rows} == {(0, 4, 1, 4, 2, 5), (0, 4, 1, 4, 3, 5)} and all(r.success for r in rows)


@pytest.mark.parametrize("full", [False, True])
def test_long_walks(spark, full):
    own = object.__new__(queries.Inputs)
    own.full, own.walked, n = full, {}, 150
    own.adjacent = graphs.adjacency(edge_table(spark, g=[(k, k + 1) for k in range(n - 1)]))
    own.coords = coord_table(spark, g=[(-0.9 + 1.8 * k / n, 0) for k in range(n)])
    own.pairs = spark.createDataFrame([("g", 0, 0, n - 1)], "graph_id string, pair_index int, source long, destination long")
    for rows in (own.ordinary(), own.repaired()):
        assert [(r.walk, r.success) for r in rows.collect()] == [(list(range(n)), True)] * 2


def test_generators():
    assert len(graphs.barabasi_albert(30, 3, 1)) == 3 * 27
    edges, attempt = graphs.erdos_renyi(30, 0.2, 1)
    assert (graphs.distances_of(30, edges[:, 0], edges[:, 1]) >= 0).all() and attempt >= 0
    with pytest.raises(ValueError):
        graphs.erdos_renyi(30, 0.0, 1, most=2)


def test_whole_design_generated(spark):
    made = graphs.generate(sampling.schedule(spark).withColumn("seed", F.col("schedule_index") + 1)).groupBy("graph_id").agg(F.count("*").alias("edges"), F.max("dst").alias("last"))
    rows = {r.graph_id: r for r in sampling.schedule(spark).join(made, "graph_id", "left").collect()}
    assert len(rows) == 360 and all(r.last == r.n - 1 for r in rows.values())
    assert all(r.edges == r.m * (r.n - r.m) for r in rows.values() if r.model == "barabasi_albert")


def test_design_of_the_table(spark, small):
    """Each graph of the table has its random graph: as many nodes, connected, and seeds, samples and names of its own."""
    of = {r.graph_id: r for r in queries.full_schedule(spark, small).collect()}
    sizes = {r.graph_id: r.n for r in queries.workload.nodes(spark, small).select("graph_id", "n").distinct().collect()}
    assert {g: r.n for g, r in of.items()} == sizes and sorted(r.schedule_index for r in of.values()) == list(range(len(sizes)))
    made = queries.generated_graphs(spark, small)
    for r in made.groupBy("graph_id").agg(F.count("*").alias("edges"), F.max("dst").alias("last"), F.min("src").alias("first")).collect():
        own = of[r.graph_id]
        assert (r.first, r.last) == (0, own.n - 1) and (own.model == "erdos_renyi" or r.edges == own.m * (own.n - own.m))
    assert all(r.connected for r in graphs.is_connected(made).collect())
    for name, least in (("graph_seeds", 5), ("sentinel_pairs", 5), ("audit_pairs", 10)):
        counts = {r.graph_id: r["count"] for r in queries.QUERIES[name](spark, small).groupBy("graph_id").count().collect()}
        assert set(counts) == set(of) and min(counts.values()) >= least


def test_embeddings():
    points = np.array([(0, 0), (0.2, 0), (0, 0.3), (-0.1, -0.15), (0.25, -0.2)])
    gap = 1 - (points**2).sum(axis=1)
    e = np.linalg.norm(points[:, None] - points[None], axis=2)
    d = 2 * np.arcsinh(e / np.sqrt(gap[:, None] * gap[None]))
    own = embedding.hydra(d)
    gap2 = 1 - (own**2).sum(axis=1)
    again = 2 * np.arcsinh(np.linalg.norm(own[:, None] - own[None], axis=2) / np.sqrt(gap2[:, None] * gap2[None]))
    assert np.abs(again - d).max() < 1e-6
    plane = np.array([(-1.2, 0.3), (0.1, -0.8), (1.4, 0.5), (0.6, 1.7), (-0.7, 1.1)])
    d = np.linalg.norm(plane[:, None] - plane[None], axis=2)
    x = embedding.classical_mds(d)
    assert np.abs(np.linalg.norm(x[:, None] - x[None], axis=2) - d).max() < 1e-9 and np.abs(x.mean(axis=0)).max() < 1e-12
    mean, residual, steps = embedding.frechet_mean(own)
    assert np.linalg.norm(mean) < 1e-9 and residual <= 1e-10 and steps <= 256
    rng = np.random.default_rng(4)
    for edge in (0.5, 1e-2, 1e-4, 1e-6):  # spread round the circle, or together near it
        for spread in (7.0, 3 * edge):
            angle, size = rng.normal(size=60) * spread + 1, 1 - edge * rng.uniform(0.2, 1.9, 60)
            points = np.column_stack([size * np.cos(angle), size * np.sin(angle)])
            mean, residual, steps = embedding.frechet_mean(points)
            assert residual <= 1e-10 and steps <= 256
            pull = sum(embedding.disk_distances(mean, p[None])[0] * (m / np.linalg.norm(m)) for p in points for m in embedding.seen_from(mean, p[None]))
            assert np.linalg.norm(pull) / 60 <= 1e-9


def test_independent_embeddings():
    """Jacobi's rotations against another solver; both embeddings by both, with repeated spectra and a ladder of close values."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 8, 33):
        a = rng.normal(size=(n, n))
        values, vectors = embedding.jacobi(a + a.T)
        assert np.allclose(values, np.linalg.eigvalsh(a + a.T), atol=1e-12 * max(1, np.abs(values).max())) and np.allclose(vectors @ np.diag(values) @ vectors.T, a + a.T, atol=1e-11)
    ring = [(k, (k + 1) % 8) for k in range(8)]
    for n, pairs in ((6, [(i, j) for i in range(6) for j in range(i)]), (8, ring), (7, [(0, k) for k in range(1, 7)]), (40, [(k, (k + 1) % 40) for k in range(40)] + [(k, (k * k * 7 + 13) % 40) for k in range(40) if (k * k * 7 + 13) % 40 != k])):
        src, dst = np.array(pairs).T
        d = graphs.distances_of(n, src, dst)
        points, found = embedding.hydra_checked(d)
        assert found["mean_residual"] <= 1e-10 and found["isometry_error"] <= 1 and found["clamped"] == 0 and np.linalg.norm(points, axis=1).max() < 1
        own = np.array([embedding.disk_distances(p, points) for p in points])
        assert np.abs(own - embedding.independent_distances(d, "hydra")).max() <= 1e-8
        plane = embedding.classical_mds(d)
        assert np.abs(np.linalg.norm(plane[:, None] - plane[None], axis=2) - embedding.independent_distances(d, "mds")).max() <= 1e-8
    assert embedding.equal_spans(np.array([3.0, 3 - 2e-10, 3 - 4e-10, 1.0])) == [(0, 2), (2, 3), (3, 4)]


def test_embedding_queries(spark, small):
    audit = queries.embedding_audit(spark, small).collect()
    assert len(audit) == 20 and all(r.largest_error <= 1e-8 and r.largest_distance > 0 for r in audit)
    assert all(r.mean_residual <= 1e-10 and r.isometry_error <= 1 for r in queries.hydra_checks(spark, small).collect())


def test_intervals_and_ranks(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("estimate"))
    (r,) = inference.percentile_interval(rows, ["k"]).collect()
    assert (r.low, r.high) == (249, 9749)
    values = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, 5.0)], "k string, v double").withColumn("r", graphs.midrank("v", "k"))
    assert sorted((x.v, x.r) for x in values.collect()) == [(1, 1), (3, 2.5), (3, 2.5), (5, 4)]
    linked = spark.createDataFrame([("a", s, float(k), float(k * k)) for s in "xy" for k in range(5)], "f string, s string, x double, y double")
    (r,) = inference.rank_association(linked, "x", "y", ["f"], ["s"], within=True).collect()
    assert r.association == pytest.approx(1) and r.na_reason is None
    (r,) = inference.rank_association(linked.withColumn("x", F.lit(1.0)), "x", "y", ["f"], ["s"], within=True).collect()
    assert r.association is None and r.na_reason == "zero_within_stratum_residual_variance_predictor"


def test_whole_replicates(spark, small):
    stream = queries.bootstrap_stream(spark, small).groupBy("model").agg(F.countDistinct("replicate").alias("replicates"), F.count("*").alias("draws"), F.max("drawn").alias("last"))
    assert [(r.replicates, r.draws, r.last) for r in stream.collect()] == [(10_000, 50_000, 4)] * 2
    p = [r.p for r in queries.permutation_associations(spark, small).where("outcome_name = 'success_contrast' and p is not null").collect()]
    assert p and all(abs(x * 10_001 - round(x * 10_001)) < 1e-6 for x in p)
    _, boot = queries.bootstrapped(queries.Inputs(spark, small, full=True))
    sizes = boot.groupBy("model", "condition_id").agg(F.countDistinct("replicate").alias("k")).collect()
    assert len(sizes) == 16 and {r.k for r in sizes} == {10_000}
    assert {"bootstrap_cells_full", "simultaneous_bands_full", "equivalence_labels_full"} <= set(queries.QUERIES)


def test_whole_pairs(spark, small):
    n = {r.graph_id: r.n for r in queries.workload.nodes(spark, small).select("graph_id", "n").distinct().collect()}
    for name in ("sampled_pairs", "route_pairs_full"):
        found = queries.QUERIES[name](spark, small).groupBy("graph_id").agg(F.count("*").alias("k"), F.countDistinct("source", "destination").alias("distinct")).collect()
        assert {r.graph_id: (r.k, r.distinct) for r in found} == {g: (min(1000, k * (k - 1)),) * 2 for g, k in n.items()}
    for name in ("success_estimands_full", "repaired_routes_i2"):
        rows = queries.QUERIES[name](spark, small)
        counted = rows.select("graph_id", "pair_count") if "pair_count" in rows.columns else rows.groupBy("graph_id", "condition_id", "metric").agg(F.count("*").alias("pair_count"))
        assert {(r.graph_id, r.pair_count) for r in counted.collect()} == {(g, min(1000, k * (k - 1))) for g, k in n.items()}
    assert all(r.violations == 0 for r in queries.QUERIES["route_violations_full"](spark, small).collect())
    own = {q: sql.removeprefix(queries.SQL) for q, sql in queries.ORACLE_SQL.items() if sql.startswith(queries.SQL)}
    walked = {q for q, sql in own.items() if re.search(r"(from|join) (pairs|route1|route2|repair1|method|graph_rows|inter|used)\b", sql)}
    routed = {q.removesuffix("_full") for q in queries.QUERIES if q.endswith("_full")}
    assert len(walked) >= 25 and walked <= routed, walked - routed


def test_pair_lengths(spark):
    """Two parts, a node without edges, more than 64 sources, one search or several; a broken distance table is told."""
    near = {"g": [(0, 1), (1, 2), (2, 3), (4, 5)] + [(k, k + 1) for k in range(6, 130)], "h": [(0, 1)]}
    edges = edge_table(spark, **near)
    rows = [("g", 1000 * s + t, s, t) for s in [*range(0, 131, 1), 140] for t in (0, 3, 5, 77, 130, 140)] + [("h", 0, 1, 0), ("h", 1, 1, 1)]
    pairs = spark.createDataFrame(rows, "graph_id string, pair_index int, source long, destination long")
    line = lambda k: 0 if k < 4 else 1 if k < 6 else 2 if k < 131 else 3
    for together in (1024, 70, 3):
        found = graphs.pair_lengths(edges, pairs, together).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r.shortest == (abs(r.source - r.destination) if line(r.source) == line(r.destination) else None), r
    apsp, lengths = graphs.all_pairs(edges), graphs.pair_lengths(edges, pairs.where("source < 131 and destination < 131"))
    of = lambda table: {r.graph_id: r.mismatches for r in validation.length_mismatches(lengths, table).collect()}
    assert of(apsp) == {"g": 0, "h": 0}
    assert of(apsp.withColumn("d", F.expr("if(graph_id = 'g' and u = 2 and v = 0, 7, d)"))) == {"g": 1, "h": 0} and of(apsp.where("not (u = 1 and v = 0)")) == {"g": 1, "h": 1}


def test_distance_counts(spark):
    """The same counts as the distance table's, for graphs in one part and in several."""
    edges = edge_table(spark, g=[(k, (k * k + 3) % 90) for k in range(90) if (k * k + 3) % 90 != k] + [(k, k + 1) for k in range(60)], h=[(0, 1), (2, 3)])
    expected = {(r.graph_id, r.d): r["count"] for r in graphs.all_pairs(edges).where("u < v").groupBy("graph_id", "d").count().collect()}
    for together in (512, 64, 7):
        assert {(r.graph_id, r.d): r.pairs for r in graphs.distance_counts(edges, together).collect()} == expected


def test_graphs_beyond_ten_labels(spark):
    rows = queries.workload.placed(spark.createDataFrame([(f"g{k}",) for k in (-3, 0, 4, 5, 10, 14, 19, 103)], "graph_id string")).collect()
    assert len({(r.model, r.replicate) for r in rows}) == len(rows)
    assert sorted((r.replicate, r.graph_id) for r in rows if r.model == "erdos_renyi") == [(0, "g0"), (1, "g4"), (2, "g10"), (3, "g14"), (4, "g103")]


def test_ratio_and_marginals(spark):
    table = spark.createDataFrame([(1, 2), (1, 0), (1, None)], "a int, b int").select(geometry.ratio(F.col("a"), F.col("b")).alias("r")).select("r.*")
    assert [tuple(r) for r in table.collect()] == [(0.5, "defined", None), (None, "undefined", "undefined_zero_denominator"), (None, "not_applicable", "design_exclusion")]
    cells = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 3.0), ("y", "p", None)], "m string, n string, value double")
    out = {(r.m, r.n): r["mean"] for r in estimands.marginals(cells, [["m"], []], "value").select("m", F.lit(None).alias("n"), "mean").collect()}
    assert out == {("x", None): 2.0, ("y", None): None, (None, None): None}


def test_samplers(spark):
    own = sampling.sample_pairs(spark.createDataFrame([("a", 5, 1), ("b", 4, 1)], "graph_id string, n long, seed long"), 12)
    rows = own.collect()
    assert len(rows) == 24 and len({(r.graph_id, r.source, r.destination) for r in rows}) == 24 and all(r.source != r.destination for r in rows)
    assert rows == own.repartition(3).orderBy("graph_id", "pair_index").collect() or sorted(rows) == sorted(own.repartition(3).collect())
    design = sampling.schedule(spark)
    assert design.count() == 360 and design.where("schedule_index = 0").first().graph_id == "er_n0100_m04_rep000" and design.where("schedule_index = 359").first().graph_id == "ba_n1000_m16_rep019"
    assert sampling.seed_collisions(spark.createDataFrame([(1,), (2,), (1,)], "seed int")).collect()[0].uses == 2
    assert json.loads(sampling.canonical({"b": 1, "a": [1, "x"]})) == {"a": [1, "x"], "b": 1}


def test_validation(spark):
    adjacent = graphs.adjacency(edge_table(spark, g=[(0, 1), (1, 2)]))
    rows = [("g", "c", 0, "m", 0, 2, [0, 1, 2], 2, True, None), ("g", "c", 1, "m", 0, 2, [0, 2], 1, True, None), ("g", "c", 2, "m", 0, 2, [0, 1, 0], 3, False, None)]
    table = spark.createDataFrame(rows, "graph_id string, condition_id string, pair_index int, metric string, source long, destination long, walk array<long>, hops int, success boolean, failure string")
    found = {r.rule: r.violations for r in validation.violations(table, adjacent).collect()}
    assert found["walk_edge_missing"] == 1 and found["length_mismatch"] == 1 and found["failure_unlabelled"] == 1 and found["ordinary_revisit"] == 1 and found["duplicate_key"] == 0
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "graph_id string")
    assert sorted(tuple(r) for r in validation.inventory(names("ab"), names("bc"), "graph_id").collect()) == [("a", "missing"), ("c", "unexpected")]
