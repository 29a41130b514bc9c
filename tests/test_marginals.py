"""Estimates by setting against plain loops, missing cells and values, evidence, strain of real embeddings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import crossed, diagnostics, embedding, graphs, marginals, walking

CELLS = [("erdos_renyi", s, d) for s in marginals.LEVELS for d in marginals.LEVELS] + [("barabasi_albert", s, d) for s in marginals.LEVELS for d in marginals.LEVELS]
SCHEMA = "model string, size string, density string, place int, condition_id string, metric string, value double, numerator long, denominator long"


def ordered(values, share):
    return sorted(values)[max(0, math.ceil(round(share * len(values), 9)) - 1)]


@pytest.fixture(scope="module")
def drawn_values(spark):
    rng = random.Random(5)
    rows = []
    for model, size, density in CELLS:
        for place in range(3):
            for metric in ("a", "b", "c"):
                n = rng.randrange(1, 9)
                value = None if (metric == "b" and place == 0) or (metric == "c" and (model, size, density) == CELLS[0]) else n / 10
                rows.append((model, size, density, place, "x_r1", metric, value, n if value is not None else None, 10))
    drawn = [(*c, r, rng.randrange(3)) for c in CELLS for r in range(60) for _ in range(3)]
    return rows, drawn, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(drawn, "model string, size string, density string, replicate int, drawn int")


def brute(rows, drawn, model, kept, metric):
    """Point, replicates and graphs of one scope; kept: the factors' levels, None where averaged."""
    cells = [c for c in CELLS if c[0] == model and all(k is None or k == v for k, v in zip(kept, c[1:]))]
    of = lambda c: {r[3]: r[6] for r in rows if r[:3] == c and r[5] == metric}
    mean = lambda v: sum(v) / len(v) if v else None
    every = lambda v: mean(v) if None not in v else None
    point = every([mean([x for x in of(c).values() if x is not None]) for c in cells])
    boot = [every([mean([of(c)[d[4]] for d in drawn if d[:3] == c and d[3] == r and of(c)[d[4]] is not None]) for c in cells]) for r in range(60)]
    return point, boot, 3 * len(cells)


def test_estimates_against_loops(drawn_values):
    rows, drawn, values, draws = drawn_values
    found = marginals.estimates(values, draws).collect()
    assert len(found) == 2 * 3 * 9
    for r in found:
        point, boot, graph_count = brute(rows, drawn, r.model, (r["size"], r.density), r.metric)
        defined = [b for b in boot if b is not None]
        assert r.estimate == (None if point is None else pytest.approx(point)) and r.graphs == graph_count
        if point is None:
            assert r.low is None and r.status == marginals.NO_STRATUM and r.metric == "c"
        elif len(defined) < 0.95 * 60:
            assert r.low is None and r.high is None and r.status == marginals.NO_INTERVAL
        else:
            assert (r.low, r.high) == (pytest.approx(ordered(defined, 0.025)), pytest.approx(ordered(defined, 0.975))) and r.status == marginals.DEFINED
        assert r.metric != "a" or (r.denominator == 10 * graph_count and r.applicable == graph_count)
        assert r.metric != "b" or (r.numerator is None and r.applicable == graph_count * 2 // 3)


def test_contrasts_against_loops(drawn_values):
    rows, drawn, values, draws = drawn_values
    for r in marginals.model_contrasts(values, draws).collect():
        (p1, b1, _), (p2, b2, _) = (brute(rows, drawn, m, (r["size"], r.density), r.metric) for m in ("barabasi_albert", "erdos_renyi"))
        assert r.estimate == (None if p1 is None or p2 is None else pytest.approx(p1 - p2))
        both = [x - y for x, y in zip(b1, b2) if x is not None and y is not None]
        if r.status == marginals.DEFINED:
            assert (r.low, r.high) == (pytest.approx(ordered(both, 0.025)), pytest.approx(ordered(both, 0.975)))


def test_a_missing_cell_leaves_its_marginals_null(drawn_values):
    _, _, values, draws = drawn_values
    gone = (F.col("model") == "erdos_renyi") & (F.col("size") == "lower") & (F.col("density") == "upper")
    found = marginals.estimates(values.where(~gone & (F.col("metric") == "a")), draws.where(~gone)).where("model = 'erdos_renyi'").collect()
    null = {(r.scope, r["size"], r.density) for r in found if r.estimate is None}
    assert null == {("size", "lower", None), ("density", None, "upper"), ("all", None, None)}
    assert {r.strata for r in found if r.scope == "all"} == {3} and all(r.status == marginals.NO_STRATUM for r in found if r.estimate is None)


def test_settings_halve_each_model(spark):
    rows = [(f"g{k}", "erdos_renyi", k, 10 if k < 4 else k, 50 - k) for k in range(7)] + [("h", "barabasi_albert", 0, 5, 5)]
    found = {r.graph_id: (r["size"], r.density, r.place) for r in marginals.settings(spark.createDataFrame(rows, "graph_id string, model string, replicate int, nodes long, edges long")).collect()}
    assert {g for g, f in found.items() if f[0] == "lower"} == {"g4", "g5", "g6", "g0", "h"}  # least nodes, ties by replicate
    assert found["g6"] == ("lower", "lower", 1) and found["g5"] == ("lower", "lower", 0) and found["h"] == ("lower", "lower", 0)
    assert len(set(found[f"g{k}"] for k in range(7))) == 7


def test_evidence_signs_and_bands(spark, drawn_values):
    rows, drawn, values, draws = drawn_values
    base = values.where("metric = 'a'")
    flip = F.when((F.col("condition_id") == "r2") & (F.col("model") == "erdos_renyi"), -F.col("value")).otherwise(F.col("value"))
    both = base.withColumn("condition_id", F.lit("r1")).unionByName(base.withColumn("condition_id", F.lit("r2"))).withColumn("value", flip)
    gains = values.where("metric = 'a'").withColumn("metric", F.lit(marginals.REPAIR)).withColumn("condition_id", F.lit("mds_r1"))
    over = spark.createDataFrame([("erdos_renyi", "hydra_r2", 0.5)], "model string, condition_id string, overhead double")
    found = {(r.model, r.radius): r for r in marginals.evidence(both, draws, gains, over).collect()}
    assert len(found) == 4
    for (model, radius), r in found.items():
        point, boot, n = brute(rows, drawn, model, (None, None), "a")
        critical = ordered([abs(b - point) for b in boot], 0.95)
        sign = -1 if (model, radius) == ("erdos_renyi", "r2") else 1
        assert (r.effect, r.low, r.high, r.graphs) == (pytest.approx(sign * point), pytest.approx(sign * point - critical), pytest.approx(sign * point + critical), n)
        assert r.consistent == (model == "barabasi_albert") and r.stretch_hydra is None
        assert r.repair_mds == (pytest.approx(point) if radius == "r1" else None)
        assert r.overhead_hydra == (0.5 if (model, radius) == ("erdos_renyi", "r2") else None)


def test_empty(drawn_values):
    _, _, values, draws = drawn_values
    assert marginals.estimates(values.where("false"), draws).count() == 0 and marginals.model_contrasts(values, draws.where("false")).where("low is not null").count() == 0


@pytest.fixture(scope="module")
def ladder(spark):
    return graphs.canonical_edges(spark.createDataFrame([("g0", u, (u * k + d) % 19) for u in range(19) for k, d in ((1, 1), (3, 2))], "graph_id string, src long, dst long"))


def test_strain_of_real_embeddings(ladder):
    native = embedding.embed(ladder).cache()
    apsp = graphs.all_pairs(ladder).cache()
    d = np.zeros((19, 19))
    for r in apsp.collect():
        d[r.u, r.v] = r.d
    x = {c: np.array([[r.x, r.y] for r in native.where(F.col("condition_id") == c).orderBy("node").collect()]) for c in ("hydra_native", "mds_native")}
    upper = np.triu_indices(19, 1)
    target, found = np.cosh(d[upper]), np.cosh(np.array([embedding.disk_distances(p, x["hydra_native"]) for p in x["hydra_native"]])[upper])
    gram = embedding.gram(d)
    want = {"hydra_native": np.linalg.norm(found - target) / np.linalg.norm(target), "mds_native": np.linalg.norm(x["mds_native"] @ x["mds_native"].T - gram) / np.linalg.norm(gram)}
    rows = embedding.strain(apsp, native).collect()
    assert {r.condition_id: r.strain for r in rows} == {c: pytest.approx(v, rel=1e-9) for c, v in want.items()} and {r.entries for r in rows} == {171, 361}
    # two axes of the spectrum are the best two: any other scale of them misses more
    worse = {r.condition_id: r.strain for r in embedding.strain(apsp, native.where("condition_id = 'mds_native'").withColumn("x", F.col("x") * 1.05)).collect()}
    assert worse["mds_native"] > want["mds_native"]


def test_walks_that_fail_after_a_repair(spark, ladder):
    native = crossed.conditions(embedding.embed(ladder)).where("condition_id <> 'mds_native'")
    pairs = spark.createDataFrame([("g0", k, k % 19, (k * 5 + 3) % 19) for k in range(60) if k % 19 != (k * 5 + 3) % 19], "graph_id string, pair_index int, source long, destination long")
    adjacent = graphs.adjacency(ladder)
    repaired = walking.repaired(walking.walks(pairs, adjacent, native, "i2")).cache()
    failed = {(r.pair_index, r.condition_id, r.metric): r for r in repaired.where("not success").collect()}
    found = diagnostics.repair_diagnostics(repaired, adjacent, native, 1e-12).collect()
    assert len(found) == len(failed) > 0
    for r in found:
        own = failed[r.pair_index, r.condition_id, r.metric]
        assert r.stopped == own.walk[-1] and r.failure == own.final_failure and r.failure_hop == own.hops
        assert r.stage == {"repair_unavailable_at_source": "repair_unavailable", "no_alternative_after_backtracking": "repair_selection"}.get(own.final_failure, "post_repair")
        assert r.stage != "repair_unavailable" or r.stopped == own.source
