"""Finished runs: folders that a filter opens, broken lines, the crossed design, and hashes of tables."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from wayfold.sources import runs

ROUTE = "graph_id string, pair_index int, source long, destination long, condition_id string, metric string, walk array<long>, hops int, decisions int, success boolean, failure string"


@pytest.fixture
def run(spark, tmp_path):
    rows = [(g, k, k, k + 1, c, m, [k, k + 1] if m == "euclidean" else [k], int(m == "euclidean"), 1, m == "euclidean", None if m == "euclidean" else "local_minimum") for g in ("g0", "g1") for k in range(3) for c in ("c0", "c1") for m in ("euclidean", "poincare")]
    routes = spark.createDataFrame(rows, ROUTE)
    return routes, runs.write_run(routes, f"file://{tmp_path}/run"), tmp_path / "run"


def design(spark):
    pairs = spark.createDataFrame([(g, k, k, k + 1) for g in ("g0", "g1") for k in range(3)], "graph_id string, pair_index int, source long, destination long")
    return pairs, spark.createDataFrame([(g, c, m) for g in ("g0", "g1") for c in ("c0", "c1") for m in ("euclidean", "poincare")], "graph_id string, condition_id string, metric string")


def of(spark, records):
    return {(r.graph_id, r.condition_id, r.problem): r.records for r in runs.run_problems(records, *design(spark)).collect()}


def test_round_trip_and_pruning(spark, run):
    routes, path, _ = run
    back = runs.read_run(spark, path)
    assert sorted(map(tuple, back.drop("broken").collect())) == sorted(map(tuple, routes.select(*runs.FIELDS).collect())) and of(spark, back) == {}
    one = back.where("condition_id = 'c1' and graph_id = 'g0' and hops = 1").select("pair_index", "walk")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 3 and "PartitionFilters: [isnotnull(condition_id" in plan and "hops" in plan.split("PushedFilters")[1].split("ReadSchema")[0] and "failure" not in plan.split("ReadSchema")[1]
    assert {f.split("/run/")[1].rsplit("/", 1)[0] for f in back.where("condition_id = 'c1' and graph_id = 'g0'").select("pair_index").withColumn("f", F.input_file_name()).select("f").distinct().toPandas()["f"]} == {"condition_id=c1/graph_id=g0"}


def test_every_problem_is_a_row(spark, run):
    _, path, folder = run
    (file,) = (folder / "condition_id=c0" / "graph_id=g1").glob("part-*")
    lines = [json.loads(x) for x in gzip.decompress(file.read_bytes()).decode().splitlines()]
    by = {(x["metric"], x["pair_index"]): x for x in lines}
    by["euclidean", 0]["hops"] = 7
    by["euclidean", 1]["destination"] = 9
    by["poincare", 0]["failure"] = None
    by["poincare", 1]["pair_index"] = 77
    text = [json.dumps(x) for x in by.values() if (x["metric"], x["pair_index"]) != ("poincare", 2)]
    text += [json.dumps(by["euclidean", 2])] * 2 + ['{"pair_index": 1, "metric": "eu', "", "not json", "{}", '{"pair_index": "x"}']
    file.write_bytes(gzip.compress("\n".join(text).encode()))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    found = of(spark, runs.read_run(spark, path))
    assert {k[:2] for k in found} == {("g1", "c0")}
    assert {k[2]: n for k, n in found.items()} == {"broken_record": 4, "no_such_cell": 1, "missing_cell": 2, "repeated_cell": 1, "other_ends": 1, "wrong_length": 1, "wrong_ending": 2}


def test_payload_hashes(spark):
    rows = [("a", 1, 0.5, None), ("a", 2, 1e-9, "x"), ("a", 2, 1e-9, "x"), ("b", 1, None, "y")]
    schema = "g string, k int, v double, s string"
    table = spark.createDataFrame(rows, schema)
    same = lambda other, **how: {r.g: r.state for r in runs.compare_payloads(table, other, ["g"], **how).collect()}
    assert same(table.orderBy(F.desc("k")).repartition(5)) == {"a": "same", "b": "same"} and same(table.select("s", "v", "k", "g")) == {"a": "same", "b": "same"}
    for other in (rows[1:], rows + rows[1:2], rows[:1] + rows[2:], [("a", 1, 0.5, "")] + rows[1:], [("a", 1, 0.5000000000000001, None)] + rows[1:]):
        assert same(spark.createDataFrame(other, schema)) == {"a": "changed", "b": "same"}
    assert same(table.where("g = 'a'")) == {"a": "same", "b": "missing"} and same(table.unionByName(table.where("g = 'b'").withColumn("g", F.lit("c")))) == {"a": "same", "b": "same", "c": "unexpected"}
    assert same(table.withColumn("k", F.col("k") + 1), without=("k",)) == {"a": "same", "b": "same"}
