"""Property associations against a plain version, replicate by replicate."""

import numpy as np
import pytest

from wayfold.operators import associations as A


def plain(x, y, strata, ranks=False):
    """Correlation of residuals by loops; None where undefined, and why."""
    keep = [k for k in range(len(x)) if y[k] is not None]
    if len(keep) < 3:
        return None, A.FEW
    rx, ry = [], []
    for s in sorted(set(strata)):
        own = [k for k in keep if strata[k] == s]
        a, b = [x[k] for k in own], [y[k] for k in own]
        if ranks:
            a, b = ([sum(w < v for w in c) + (sum(w == v for w in c) + 1) / 2 for v in c] for c in (a, b))
        rx += [v - np.mean(a) for v in a]
        ry += [v - np.mean(b) for v in b]
    if np.linalg.norm(rx) < 1e-10:
        return None, A.NO_X
    if np.linalg.norm(ry) < 1e-10:
        return None, A.NO_Y
    return float(np.dot(rx, ry) / np.linalg.norm(rx) / np.linalg.norm(ry)), None


def design(seed, missing):
    rng = np.random.default_rng(seed)
    graphs = [(f"s{k % 3}", f"g{k:02d}") for k in range(21)]
    x = {g: (float(rng.integers(0, 5)), rng.normal(), 7.25, float(k)) for k, (_, g) in enumerate(graphs)}
    rows = []
    for model in ("er", "ba"):
        for s, g in graphs:
            for c in range(5):
                y = x[g][1] * c + rng.normal() + 3 * int(s[1])
                y = {3: 1.5, 4: None if int(g[1:]) > 1 else y}.get(c, y)
                rows.append((model, "success", s, g, f"c{c}", None if missing and rng.random() < 0.2 else y, *x[g]))
    return rows


SCHEMA = "model string, outcome_name string, stratum string, graph_id string, condition_id string, outcome double, p0 double, p1 double, p2 double, p3 double"
NAMES, KEYS = ["p0", "p1", "p2", "p3"], ["model", "outcome_name"]


@pytest.mark.parametrize("missing", [False, True])
def test_every_replicate(spark, missing):
    rows, n = design(1, missing), 60
    got = A.property_associations(spark.createDataFrame(rows, SCHEMA).repartition(4), NAMES, KEYS, replicates=n, block=25, plan_hash="h").collect()
    assert len(got) == 2 * 4 * 5
    for model in ("er", "ba"):
        own = sorted(r for r in rows if r[0] == model)
        graphs = sorted({(r[2], r[3]) for r in own})
        strata = [s for s, _ in graphs]
        x = {p: [next(r[6 + k] for r in own if r[3] == g) for _, g in graphs] for k, p in enumerate(NAMES)}
        y = {c: [next(r[5] for r in own if r[3] == g and r[4] == c) for _, g in graphs] for c in {r[4] for r in own}}
        order = A.Strata(strata)
        family = {"model": model, "outcome_name": "success"}
        moved = order.maps(0, n, lambda s, k, m: A.generator("h", "permutation", family, s, k).permutation(m))
        again = order.maps(0, n, lambda s, k, m: A.generator("h", "bootstrap", {"model": model}, s, k).integers(0, m, m))
        assert all(sorted(m[s]) == list(range(s.start, s.stop)) for m in moved for _, s in order.parts)
        stat = {(p, c): [plain(x[p], [y[c][k] for k in m], strata)[0] for m in moved] for p in x for c in y}
        largest = [max(abs(v[r]) for v in stat.values() if v[r] is not None) for r in range(n)]
        for r in (r for r in got if r.model == model):
            value, why = plain(x[r.property], y[r.condition_id], strata)
            assert r.na_reason == why and r.defined == sum(v is not None for v in y[r.condition_id]) and r.graphs == 21
            if value is None:
                assert r.association is r.p is r.family_p is None
                continue
            assert r.association == pytest.approx(value) and r.rank_association == pytest.approx(plain(x[r.property], y[r.condition_id], strata, True)[0])
            own_stat = [abs(v) for v in stat[r.property, r.condition_id] if v is not None]
            assert r.p == pytest.approx((1 + sum(v >= abs(value) - 1e-9 for v in own_stat)) / (1 + len(own_stat)))
            assert r.family_p == pytest.approx((1 + sum(v >= abs(value) - 1e-9 for v in largest)) / (1 + n))
            for ranks, low, high in ((False, r.low, r.high), (True, r.rank_low, r.rank_high)):
                drawn = [plain([x[r.property][k] for k in a], [y[r.condition_id][k] for k in a], strata, ranks)[0] for a in again]
                drawn = sorted(v for v in drawn if v is not None)
                if len(drawn) < 57:
                    assert low is high is None
                else:
                    assert (low, high) == pytest.approx((drawn[int(np.ceil(0.025 * len(drawn))) - 1], drawn[int(np.ceil(0.975 * len(drawn))) - 1]))


def test_equal_hypotheses_share_their_maps(spark):
    """Six times the same hypothesis: each p is the same, and so is the family's."""
    rng = np.random.default_rng(2)
    rows = [("er", "success", "s", f"g{k:02d}", f"c{c}", float(k % 7 + v), *[float(v)] * 4) for k, v in enumerate(rng.normal(size=30)) for c in range(6)]
    got = A.property_associations(spark.createDataFrame(rows, SCHEMA), ["p0"], KEYS, replicates=400, block=100).collect()
    assert len(got) == 6 and len({r.p for r in got}) == 1 and all(r.p == r.family_p for r in got) and len({r.fingerprint for r in got}) == 1


def test_blocks_change_nothing_and_errors(spark):
    table = spark.createDataFrame(design(3, True), SCHEMA)
    one, other = (sorted(map(tuple, A.property_associations(table, NAMES, KEYS, replicates=50, block=b).collect())) for b in (50, 7))
    assert [[v if not isinstance(v, float) else round(v, 9) for v in r] for r in one] == [[v if not isinstance(v, float) else round(v, 9) for v in r] for r in other]
    assert A.property_associations(table.limit(0), NAMES, KEYS, replicates=5).collect() == []
    with pytest.raises(Exception, match="each graph once"):
        A.property_associations(table.where("not (graph_id = 'g03' and condition_id = 'c1')"), NAMES, KEYS, replicates=5).collect()
