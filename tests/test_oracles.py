"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["graph_edges", "local_clustering", "network_metrics", "greedy_routes_i1", "repaired_routes_i1", "greedy_routes_i2", "success_estimands", "full_schedule", "pair_bijection", "matched_probability", "mobius_translation", "route_violations", "interaction_intervals", "model_contrast_intervals", "marginal_intervals", "stratum_coverage", "pooled_failures", "failure_diagnostics", "distance_change", "coordinate_summary", "matrix_violations", "metric_counts", "graph_row_violations", "recovered_stretch", "capacity_cells", "graph_identities", "family_labels", "walk_resources", "resource_summary_i2", "pair_lengths", "length_mismatches", "association_statistics", "frozen_workload", "stored_routes", "run_problems", "payload_hashes", "metric_estimates", "interaction_estimates", "model_contrast_estimates", "evidence_rows", "repair_diagnostics", "embedding_strain"]


def shown(v):
    return "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    other = con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert mine == sorted(tuple(shown(v) for v in r) for r in other)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
