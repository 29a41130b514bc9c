"""Incremental ingest of finished graph results: each graph's rows are taken once, however often they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfold.sources.tables import ROUTES


def routes_stream(spark: SparkSession, path: str) -> DataFrame:
    """Route records as files arrive."""
    return spark.readStream.schema(ROUTES).json(path)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch under its number; a batch that runs again replaces its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.dropDuplicates(["graph_id", "pair_index", "condition_id", "metric"])
        keyed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def success_by_graph(spark: SparkSession, target: str) -> DataFrame:
    """Rates over all batches, keys that several batches hold counted once."""
    rows = spark.read.parquet(target).dropDuplicates(["graph_id", "pair_index", "condition_id", "metric"])
    return rows.groupBy("graph_id", "condition_id", "metric").agg(F.count("*").alias("routes"), F.avg(F.col("success").cast("int")).alias("success_rate"))
