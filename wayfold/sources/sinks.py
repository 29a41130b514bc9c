"""Sinks: idempotent graph results with a manifest, CSV and JSON lines, and small workbooks."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The row limit of the workbook format.
SHEET_ROWS = 1_048_576


def publish(results: DataFrame, root: str, run_id: str) -> None:
    """Writes the results of a run in graph folders, then its manifest; a run without a manifest doesn't count."""
    results.write.partitionBy("graph_id").mode("errorifexists").parquet(f"{root}/run={run_id}/rows")
    back = results.sparkSession.read.parquet(f"{root}/run={run_id}/rows")
    back.groupBy("graph_id").agg(F.count("*").alias("rows")).withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").parquet(f"{root}/run={run_id}/manifest")


def remaining(schedule: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scheduled graphs that no manifest has: what a resumed run has to do."""
    return schedule.join(manifest.select("graph_id").distinct(), "graph_id", "left_anti")


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted by range, nulls as empty fields; part files in order make the table."""
    df.orderBy(*order).write.option("header", True).option("nullValue", "").option("compression", "gzip").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def sheet_xml(header: list[str], rows: list[tuple]) -> str:
    if len(rows) >= SHEET_ROWS:
        raise ValueError("too many rows for a sheet")
    lines = []
    for r, row in enumerate([tuple(header), *rows], 1):
        cells = []
        for c, v in enumerate(row):
            at = f"{column_name(c)}{r}"
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{at}"><v>{v!r}</v></c>')
            else:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape("NA" if v is None else str(v))}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    last = f"{column_name(max(0, len(header) - 1))}{len(rows) + 1}"
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<sheetData>{"".join(lines)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>'


def workbook(sheets: dict[str, DataFrame]) -> bytes:
    """A workbook of reporting tables; each is an aggregate and has less rows than a sheet allows."""
    parts = {name[:31]: (df.columns, [tuple(r) for r in df.limit(SHEET_ROWS).collect()]) for name, df in sheets.items()}
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    n = range(1, len(parts) + 1)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, parts, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>",
        **{f"xl/worksheets/sheet{k}.xml": sheet_xml(*part) for k, part in zip(n, parts.values(), strict=True)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def audit(spark: SparkSession, root: str, schedule: DataFrame) -> DataFrame:
    """(state, graphs): how many scheduled graphs are complete in any run's manifest."""
    manifest = spark.read.option("basePath", root).parquet(f"{root}/run=*/manifest")
    done = schedule.join(manifest.select("graph_id").distinct().withColumn("done", F.lit(True)), "graph_id", "left")
    return done.groupBy(F.when(F.col("done"), "complete").otherwise("remaining").alias("state")).agg(F.count("*").alias("graphs"))
