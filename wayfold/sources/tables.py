"""Readers: routes, coordinates, edges and results with fixed schemas, and losslessly coded floats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.shipping import ship

EDGES = "graph_id string, src long, dst long"
PAIRS = "graph_id string, pair_index int, source long, destination long"
COORDS = "graph_id string, condition_id string, node long, x string, y string"
ROUTES = "graph_id string, pair_index int, source long, destination long, condition_id string, metric string, walk array<long>, hops int, decisions int, success boolean, failure string"


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """CSV, plain or compressed, with a header."""
    return spark.read.csv(path, schema=EDGES, header=True, mode="FAILFAST")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PAIRS, header=True, mode="FAILFAST")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, plain or compressed."""
    return spark.read.json(path, schema=ROUTES, mode="FAILFAST")


def from_hex(df: DataFrame, *columns: str) -> DataFrame:
    """Hexadecimal float strings as doubles, exactly."""
    ship(df.sparkSession)

    @F.pandas_udf("double")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(float.fromhex, na_action="ignore").astype("float64")

    return df.withColumns({c: parse(F.col(c)) for c in columns})


def to_hex(df: DataFrame, *columns: str) -> DataFrame:
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else float(v).hex() for v in s], dtype=object)

    return df.withColumns({c: show(F.col(c)) for c in columns})


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    return from_hex(spark.read.csv(path, schema=COORDS, header=True, mode="FAILFAST"), "x", "y")


def tree_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of all files below root, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
