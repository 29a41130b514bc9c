"""Certified comparisons and the audit of walked routes, with near ties that doubles get wrong."""

import math
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from wayfold.operators import graphs, oracle, walking
from wayfold.plans import queries

ULP = math.ulp(0.5)


def test_bounds_hold_and_decide():
    """Each bound covers the decimal distance, also near the circle and for near points; comparisons are those of the decimals."""
    rng = random.Random(1)
    at = {}
    for k in range(400):
        r, a = rng.choice([rng.random(), 1 - 10 ** -rng.uniform(1, 12), 1e-9 * rng.random()]), rng.uniform(0, 7)
        at[k] = (r * math.cos(a), r * math.sin(a)) if k % 5 else tuple(c + rng.choice([0, 1e-15, 3e-13]) for c in at.get(k - 1, (0.1, 0.2)))
    at = {k: p for k, p in at.items() if math.hypot(*p) < 1}
    for metric in ("euclidean", "poincare"):
        for target in list(at)[:12]:
            one = oracle.Certified(metric, at, target)
            for k in at:
                value, error = one.bound(k)
                with localcontext() as context:
                    context.prec = 80
                    assert abs(Decimal(value) - one.exact(k)) <= Decimal(error)
            assert one.refined == 0
            for _ in range(60):
                a, b, shift = rng.choice(list(at)), rng.choice(list(at)), rng.choice([0.0, 1e-12, -1e-12, 1e-16])
                with localcontext() as context:
                    context.prec = 80
                    assert one.below(a, b, shift) == (one.exact(a) - one.exact(b) - Decimal(shift) < -oracle.OPEN)


def test_decimals_only_where_needed():
    at = {0: (0.0, 0.0), 1: (0.5, 0.0), 2: (0.0, 0.5), 3: (0.5 + ULP, 0.0), 4: (0.7, 0.0)}
    one = oracle.Certified("euclidean", at, 0)
    assert one.below(1, 4) and not one.below(4, 1) and one.refined == 0
    assert one.below(1, 3) and not one.below(3, 1) and one.refined == 2 and one.open == 0
    assert not one.below(1, 2) and not one.below(2, 1) and one.open == 2


def planted(spark, tolerance):
    """A source with two neighbours: 1 is further than 2 by 9,008 units of the last place."""
    places = {0: (0.9, 0.0), 2: (0.5, 0.0), 1: (0.5 + 9008 * ULP, 0.0), 3: (0.0, 0.0)}
    adjacent = graphs.adjacency(spark.createDataFrame([("g", 0, 1), ("g", 0, 2), ("g", 1, 3), ("g", 2, 3)], "graph_id string, src long, dst long"))
    coords = spark.createDataFrame([("g", "c", k, *p) for k, p in places.items()], "graph_id string, condition_id string, node long, x double, y double").withColumn("euclidean_tolerance", F.lit(tolerance)).withColumn("poincare_tolerance", F.lit(None).cast("double"))
    pairs = spark.createDataFrame([("g", 0, 0, 3)], "graph_id string, pair_index int, source long, destination long")
    return pairs, adjacent, coords


def test_a_planted_near_tie_is_told(spark):
    """Doubles round the sum of distance and tolerance up to the further neighbour and take the smaller id; exactly it isn't tied."""
    for units, wrong in ((9007.6, True), (9100.0, False), (8000.0, False)):
        tables = planted(spark, units * ULP)
        walked, again = walking.walks(*tables, "i1"), oracle.independent_routes(*tables, "i1")
        (r,) = oracle.audit(walked, again).collect()
        assert (r.pairs, r.agreeing, r.disagreeing, r.undecided) == (1, 1 - wrong, int(wrong), 0)
        assert (r.double_disagreeing, r.refined > 0) == (int(wrong), wrong)
        walks = {x.precision: x.walk for x in again.collect()}
        assert walks["certified"] == ([0, 1, 3] if units == 9100 else [0, 2, 3])


def test_changed_and_missing_routes_disagree(spark):
    pairs, adjacent, coords = planted(spark, 1e-9)
    walked, again = walking.walks(pairs, adjacent, coords, "i1"), oracle.independent_routes(pairs, adjacent, coords, "i1")
    (r,) = oracle.audit(walked.withColumn("walk", F.array(F.lit(0), F.lit(2), F.lit(3)).cast("array<long>")), again).collect()
    assert (r.agreeing, r.disagreeing, r.double_disagreeing) == (0, 1, 0)
    (r,) = oracle.audit(walked.where("false"), again).collect()
    assert r.disagreeing == 1
    # a tie that no precision decides: both neighbours equally far, by different coordinates
    even = coords.withColumn("x", F.when(F.col("node") == 1, 0.0).otherwise(F.col("x"))).withColumn("y", F.when(F.col("node") == 1, 0.5).otherwise(F.col("y"))).withColumn("euclidean_tolerance", F.lit(1e-300))
    (r,) = oracle.audit(walking.walks(pairs, adjacent, even, "i1"), oracle.independent_routes(pairs, adjacent, even, "i1")).collect()
    assert (r.pairs, r.undecided) == (1, 1)


@pytest.mark.parametrize("name", ["route_audit", "route_audit_i1"])
def test_audit_queries(spark, small, name):
    rows = queries.QUERIES[name](spark, small).collect()
    size = 5 if name == "route_audit" else 10
    assert len(rows) == 160 and all(r.pairs == size and r.agreeing + r.undecided == size and r.disagreeing == 0 for r in rows)
