"""Sources, sinks and the incremental ingest."""

import io
import zipfile

import pytest

from wayfold.sources import sinks, tables
from wayfold.streaming import ingest


def test_hex_and_csv(spark, tmp_path):
    rows = spark.createDataFrame([("g", "c", 0, 0.1, 1e-300), ("g", "c", 1, -0.3, None)], "graph_id string, condition_id string, node long, x double, y double")
    sinks.write_csv(tables.to_hex(rows, "x", "y"), f"file://{tmp_path}/c", ["graph_id", "node"])
    assert sorted(map(tuple, tables.read_coords(spark, f"file://{tmp_path}/c").collect())) == sorted(map(tuple, rows.collect()))
    assert tables.tree_fingerprint(spark, f"file://{tmp_path}/c").where("length(sha256) = 64").count() >= 1


def test_publish_and_resume(spark, tmp_path):
    root, schedule = f"file://{tmp_path}/r", spark.createDataFrame([("a",), ("b",)], "graph_id string")
    results = spark.createDataFrame([("a", 1), ("a", 2)], "graph_id string, v int")
    sinks.publish(results, root, "one")
    with pytest.raises(Exception, match="exists"):
        sinks.publish(results, root, "one")
    manifest = spark.read.parquet(f"{root}/run=one/manifest")
    assert [r.graph_id for r in sinks.remaining(schedule, manifest).collect()] == ["b"]
    assert {r.state: r.graphs for r in sinks.audit(spark, root, schedule).collect()} == {"complete": 1, "remaining": 1}


def test_workbook(spark):
    data = sinks.workbook({"cells": spark.createDataFrame([("a<b", 1.5, None)], "k string, v double, n int")})
    assert data == sinks.workbook({"cells": spark.createDataFrame([("a<b", 1.5, None)], "k string, v double, n int")})
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and "<v>1.5</v>" in sheet and ">NA<" in sheet and 'autoFilter ref="A1:C2"' in sheet


def test_ingest(spark, tmp_path):
    row = '{"graph_id":"g","pair_index":%d,"source":0,"destination":1,"condition_id":"c","metric":"m","walk":[0,1],"hops":1,"decisions":1,"success":%s,"failure":null}\n'
    (tmp_path / "in").mkdir()
    for k, text in enumerate([row % (0, "true") + row % (1, "false"), row % (0, "true")]):
        (tmp_path / "in" / f"{k}.json").write_text(text)
        ingest.ingest(ingest.routes_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    (r,) = ingest.success_by_graph(spark, f"file://{tmp_path}/out").collect()
    assert (r.routes, r.success_rate) == (2, 0.5)
