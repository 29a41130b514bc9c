"""Quartiles of groups from counts of values."""

import statistics

from wayfold.operators import inference


def test_quartiles_with_ties_nulls_and_a_null_group(spark):
    """Several values a bin and bins without any; a group of nulls alone; a null group beside the row over all."""
    rows = [("a", v) for v in (1.0, 1.0, 500.0, 2.5, 63.99, 64.0, -3.0)] + [("b", None), (None, 7.0), (None, 9.0), ("c", 5.5), ("c", None)]
    got = sorted(map(tuple, inference.grouped_quartiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()), key=repr)
    want = []
    for name in ("a", "b", "c", None, "every"):
        own = [v for k, v in rows if name == "every" or k == name]
        known = sorted(v for v in own if v is not None)
        rank = lambda share: known[max(-(-len(known) * share // 4), 1) - 1] if known else None
        want.append((None if name == "every" else name, sum(known) if known else None, statistics.median(known) if known else None, rank(1), rank(3), len(own)))
    assert got == sorted(((k, *(round(x, 2) if isinstance(x, float) else x for x in r)) for k, *r in want), key=repr)
    assert [tuple(r) for r in inference.grouped_quartiles(spark.createDataFrame([], "k string, v double"), "k", "v").collect()] == [(None, None, None, None, None, 0)]
