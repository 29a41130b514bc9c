"""Diagnostics, identities and table checks on small cases, nulls and empty tables among them."""

import json
from hashlib import blake2s

import numpy as np
import pytest

from wayfold.operators import diagnostics, identities, sampling


def number(payload, person, size):
    return int.from_bytes(blake2s(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode(), digest_size=size, person=person).digest(), "big")


def test_matrix_violations(spark):
    schema = "graph_id string, u long, v long, d double"
    sound = [("a", u, v, float(u != v)) for u in range(3) for v in range(3)]
    bad = [("b", 0, 0, 0.5), ("b", 1, 1, 0.0), ("b", 0, 1, 2.0), ("b", 0, 1, 2.0), ("b", 1, 0, 1.0), ("b", 2, 2, 0.0), ("b", 1, 2, float("nan")), ("b", 2, 1, -1.0), ("b", 2, 0, None)]
    got = {r.graph_id: tuple(r)[1:] for r in diagnostics.matrix_violations(spark.createDataFrame(sound + bad, schema)).collect()}
    assert got["a"] == (3, 0, 0, 0, 0, 0, 0)
    assert got["b"] == (3, 1, 1, 2, 1, 1, 2)
    assert diagnostics.matrix_violations(spark.createDataFrame([], schema)).count() == 0


def test_graph_row_violations(spark):
    schema = "graph_id string, condition_id string, model string, euclidean long, poincare long, repaired long, pair_count long"
    rows = [("a", "x", "er", 1, 2, 3, 5), ("a", "y", "er", 0, 0, 0, 5), ("b", "x", "er", 9, 2, 1, 5), ("b", "x", "ba", 1, 1, 1, 6)]
    got = {r.graph_id: tuple(r)[1:] for r in diagnostics.graph_row_violations(spark.createDataFrame(rows, schema), 2, ["model"]).collect()}
    assert got == {"a": (0, 0, 0, 0, 0, 0), "b": (1, 1, 1, 1, 1, 1)}


def test_capacity_cells(spark):
    rows = [("a", 0, 99.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 2.0), ("b", 2, 4.0), ("c", 0, 1.0), ("c", 1, 0.0), ("c", 2, 0.0), ("d", 0, 1.0), ("d", 1, 1.0), ("d", 1, 1.0), ("d", 2, 1.0)]
    got = {r.cell_id: tuple(r)[1:] for r in diagnostics.capacity_cells(spark.createDataFrame(rows, "cell_id string, repetition int, runtime double")).collect()}
    assert got == {"a": (True, 3.0, 4.0, 2.0, 2.0, 2 / 3), "b": (False, *[None] * 5), "c": (True, 0.0, 0.0, 0.0, 0.0, 0.0), "d": (False, *[None] * 5)}


def test_failure_diagnostics(spark):
    """A path 0 - 1 - 2 with a gap before 3: the walk from 0 to 3 stops at 2."""
    routes = spark.createDataFrame([("g", 0, "c", "euclidean", 3, [0, 1, 2], False, "local_minimum"), ("g", 1, "c", "euclidean", 1, [0, 1], True, None), ("g", 2, "c", "euclidean", 3, [4], False, "local_minimum")], "graph_id string, pair_index int, condition_id string, metric string, destination long, walk array<long>, success boolean, failure string")
    adjacent = spark.createDataFrame([("g", a, b) for a, b in [(0, 1), (1, 0), (1, 2), (2, 1)]], "graph_id string, node long, neighbour long")
    coords = spark.createDataFrame([("g", "c", k, 0.1 * k, 0.0) for k in range(5)], "graph_id string, condition_id string, node long, x double, y double")
    got = {r.pair_index: r for r in diagnostics.failure_diagnostics(routes, adjacent, coords, 1e-12).collect()}
    assert set(got) == {0, 2} and (got[0].stopped, got[0].failure_hop, got[0].terminal_degree) == (2, 2, 1)
    assert (got[0].current_distance, got[0].best_neighbour_distance, got[0].progress_gap) == pytest.approx((0.1, 0.2, -0.1))
    assert (got[2].terminal_degree, got[2].best_neighbour_distance, got[2].progress_gap) == (0, None, None)


def test_distance_change_outside_the_disk(spark):
    before = spark.createDataFrame([("g", "f", 0, 2.0, 0.0), ("g", "f", 1, 0.0, 0.0), ("g", "f", 2, 0.0, 0.0)], "graph_id string, family string, node long, x double, y double")
    after = before.selectExpr("graph_id", "family", "node", "x / 4 as x", "y / 4 as y", "'c' as condition_id", "0.25D as scale")
    (row,) = diagnostics.distance_change(before, after).collect()
    assert (row.pairs, row.coincident, row.poincare_before, row.poincare_change) == (3, 1, None, None)
    assert (row.euclidean_before, row.euclidean_after, row.largest_scale_error) == pytest.approx((4 / 3, 1 / 3, 0.0))


def test_pair_sensitivity(spark):
    """The standard error of independent draws: root of the mean variance over pairs and graphs; alike on any partitioning."""
    rng = np.random.default_rng(1)
    values = {f"g{k}": rng.choice([-1.0, 0.0, 1.0], size=1000, p=[0.2, 0.5, 0.3]) for k in range(6)}
    rows = spark.createDataFrame([(g, float(v)) for g, own in values.items() for v in own] + [("g0", None)], "graph_id string, value double")
    got = {r.pairs: r for r in diagnostics.pair_sensitivity(rows).collect()}
    for pairs, r in got.items():
        expected = 100 * np.sqrt(sum(v.var() / pairs for v in values.values())) / len(values)
        assert (r.replicates, r.graphs) == (2000, 6) and r.standard_error == pytest.approx(expected, rel=0.08)
    again = {r.pairs: r.standard_error for r in diagnostics.pair_sensitivity(rows.repartition(7)).collect()}
    assert again == pytest.approx({p: r.standard_error for p, r in got.items()}, rel=1e-12)
    assert diagnostics.pair_sensitivity(rows.where("graph_id = 'g1'")).count() == 0


def test_graph_seeds(spark):
    design = sampling.schedule(spark).where("n = 100 and m = 4 and replicate_index < 2")
    got = {(r.graph_id, r.purpose, r.attempt): int(r.seed) for r in identities.graph_seeds(design, "h").collect()}
    assert len(got) == 4 * 5 + 2 * 50
    for r in design.collect():
        own = [r.model, r.n, r.m, r.replicate_index, r.graph_id]
        base = {"identity_hash": "h", "seed_identity_version": 2}
        assert got[r.graph_id, "pairs", None] == number({**base, "domain": "pairs", "master": 13_000_003, "identity": own}, b"GRP2seed", 4)
        assert got[r.graph_id, "validation_sentinel", None] == number({**base, "domain": "validation_sentinel", "master": 16_000_019, "identity": r.graph_id}, b"GRP2seed", 8)
        if r.model == "erdos_renyi":
            assert got[r.graph_id, "er_attempt", 49] == number({**base, "domain": "er_attempt", "master": 11_000_003, "identity": [*own, 49]}, b"GRP2seed", 4)
    assert identities.graph_seeds(design.limit(0)).count() == 0


def test_samples_of_pairs(spark):
    design = sampling.schedule(spark).where("n = 100 and replicate_index < 2")
    sentinel, audit = identities.sentinel_pairs(design, 40, "h").collect(), identities.audit_pairs(design, 7, "h").collect()
    by = {}
    for r in sentinel:
        by.setdefault((r.graph_id, r.census), []).append(r.pair_index)
    assert {len(v) for (_, census), v in by.items() if census} == {40} and sum(census for _, census in by) == 4
    assert {len(set(v)) for (_, census), v in by.items() if not census} == {5} and all(0 <= i < 40 for r in by.values() for i in r)
    one = {}
    for r in audit:
        one.setdefault(r.graph_id, []).append(r.pair_index)
    assert all(sorted(v) == list(range(7)) for v in one.values()) and len({tuple(v) for v in one.values()}) > 6
    first = number({"combined_freeze_hash": "h", "counter": 0, "domain": "step17_route_audit_v1", "graph_id": "x", "rejection_counter": 0}, b"GRP17aud", 8) % 1000
    assert identities.audit_indices("x", 1000, "h")[0] == first and identities.audit_indices("x", 0, "h") == []


def test_identities(spark):
    pairs = spark.createDataFrame([("g", 3, 1, 2)], "graph_id string, pair_index int, source long, destination long")
    payload = {"domain": "pair_sampling", "schema": "iteration2_pair_sampling_identity_v1", "data_generation_hash": "h", "graph_id": "g", "pair_index": 3, "source": 1, "destination": 2}
    assert identities.pair_identities(pairs, "h").first().identity == f"{number(payload, b'i2idv1', 16):032x}"
    assert identities.domain_seed(5, "d", "a", 1) == number({"algorithm": "blake2s-32-domain-separated-v1", "domain": "d", "identity": ["a", 1], "master_seed": 5}, b"GRPseed1", 4)
    assert identities.property_seed("p", 1, "x") == number({"analysis_plan_hash": "p", "seed_identity_version": 2, "master": 14_000_003, "family": "iteration2_property_associations_v2", "identity": [1, "x"]}, b"GRP2prop", 8)


def test_walk_resources(spark):
    """Counted along whole walks of the second protocol, repaired ones too, by an instrumented walk of its own."""
    import random

    from pyspark.sql import functions as F

    from wayfold.operators import walking

    rng = random.Random(4)
    n = 40
    place = {k: (rng.uniform(-0.6, 0.6), rng.uniform(-0.6, 0.6)) for k in range(n)}
    near = {k: set() for k in range(n)}
    for k in range(n):
        for j in (k + 1, rng.randrange(n)):
            if k != j % n:
                near[k].add(j % n)
                near[j % n].add(k)
    adjacent = spark.createDataFrame([("g", a, b) for a in near for b in near[a]], "graph_id string, node long, neighbour long")
    coords = spark.createDataFrame([("g", "c", k, *p) for k, p in place.items()], "graph_id string, condition_id string, node long, x double, y double")
    pairs = spark.createDataFrame([("g", k, *rng.sample(range(n), 2)) for k in range(80)], "graph_id string, pair_index int, source long, destination long")
    walked = walking.walks(pairs, adjacent, coords, "i2").where("metric = 'euclidean'").cache()
    plain = walking.ordinary(walked)
    fixed = walking.repaired(walked).join(plain.select("pair_index", F.col("hops").alias("h")), "pair_index").withColumn("initial_hops", F.expr("case when attempted then h end"))

    def costs(walk, target, back=None):
        total = 0
        for at, v in enumerate(walk):
            if v == target:
                continue
            if back is not None and at == back + 1:
                free = near[v] - set(walk[: back + 1])
                total += 0 if target in free else len(free)
            elif target not in near[v]:
                total += 1 + len(near[v])
        return total, len(set(walk))

    for r in diagnostics.walk_resources(plain, adjacent).collect():
        assert (r.evaluations, r.history) == costs(r.walk, r.destination)
    hops = {r.pair_index: r.initial_hops for r in fixed.collect()}
    rows = diagnostics.walk_resources(fixed, adjacent).collect()
    assert sum(h is not None for h in hops.values()) > 3
    for r in rows:
        assert (r.evaluations, r.history) == costs(r.walk, r.destination, hops[r.pair_index])


def test_repeated_eigenvalues():
    """A basis of a repeated eigenspace is the same for every rotation that a solver may return."""
    from wayfold.operators import embedding

    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    values = np.array([5.0, 3.0, 3.0, 3.0, 1.0, -2.0, -2.0])
    one = embedding.settled(values, q)
    for _ in range(5):
        turned = q.copy()
        for low, high in ((1, 4), (5, 7)):
            turned[:, low:high] = q[:, low:high] @ np.linalg.qr(rng.normal(size=(high - low, high - low)))[0]
        other = embedding.settled(values, turned * rng.choice([-1, 1], size=7))
        assert np.allclose(other, one, atol=1e-10)
    assert np.allclose(one.T @ one, np.eye(7), atol=1e-12) and np.allclose(one @ np.diag(values) @ one.T, q @ np.diag(values) @ q.T, atol=1e-10)
    complete = 1.0 - np.eye(5)
    assert np.isfinite(embedding.classical_mds(complete)).all() and np.linalg.norm(embedding.hydra(complete), axis=1).max() < 1


def test_spectral_diagnostics(spark):
    from wayfold.operators import embedding

    ring = spark.createDataFrame([("ring", k, (k + 1) % 6) for k in range(6)] + [("path", 0, 1)], "graph_id string, src long, dst long")
    got = {(r.graph_id, r.family): r for r in embedding.spectral_diagnostics(ring).collect()}
    d = np.array([[min((a - b) % 6, (b - a) % 6) for a in range(6)] for b in range(6)], float)
    values = np.sort(np.linalg.eigvalsh(np.cosh(d)))[::-1]
    r = got["ring", "hydra"]
    assert sorted([*r.retained, *r.rejected]) == pytest.approx(sorted(values)) and r.retained[0] == pytest.approx(values[0]) and len(r.retained) == 1 + (values[-2:] < -r.zero).sum()
    assert len(got["ring", "mds"].retained) == 2 and len(got["path", "mds"].retained) == 1 and got["path", "mds"].retained[0] == pytest.approx(0.5)
    assert embedding.spectral_diagnostics(ring.limit(0)).count() == 0
