"""Shared helpers: byte-level words, Arrow mapping, tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold._tables import dropped, shared_path, written
from wayfold.shipping import ship

__all__ = ["ALNUM", "alnum_words", "caches", "dropped", "filtered", "given_back", "in_arrow", "in_duck", "in_groups", "mapped", "shared_path", "slices", "space_words", "texts", "written"]

#: Maps A-Z to a-z, every other ASCII byte that is no digit or letter to a space; bytes from 0x80 stay.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 text."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x20\\x09-\\x0D]+ of UTF-8 text (bytes.split has the same separators)."""
    return text.lower().split()


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes in a string column, or one row where that has more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def given_back() -> None:
    """Returns what Arrow's pool and the C heap hold free to the system; a worker lives on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: What empties the caches that an operator keeps in a worker from task to task, by operator.
caches: dict[str, Callable[[], None]] = {}


def only(keeps: str | None) -> None:
    """Empties all operators' caches but one's: a worker holds those of the operator that it runs alone."""
    for name, emptied in caches.items():
        if name != keeps:
            emptied()


#: Bytes of an Arrow batch between the JVM and a worker: Spark's own bound leaves 64 MB, once for each task on either side.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def prepared(df: DataFrame) -> None:
    """Ships the package, and bounds the session's Arrow batches where the user hasn't set a bound."""
    spark = df.sparkSession
    ship(spark)
    if str(spark.conf.get(BATCH_KEY, "67108864b")).rstrip("b") == "67108864":  # Spark's default
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with this package on the workers' path; a task's free memory goes back when it ends, other operators' caches when it begins."""
    prepared(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(keeps)
        try:
            yield from fn(batches)
        finally:
            given_back()

    return df.mapInArrow(run, schema)


def in_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow over groups that the caller keeps bounded, with this package on the workers' path."""
    prepared(df)

    def run(rows: pa.Table) -> pa.Table:
        only(None)
        try:
            return fn(rows)
        finally:
            given_back()

    return df.groupBy(*keys).applyInArrow(run, schema)


def mapped(df: DataFrame, keep: list[str], used: list[str], fields: T.StructType, fn: Callable[[pa.RecordBatch], list[pa.Array]], keeps: str | None = None) -> DataFrame:
    """Adds fields to the kept columns, batch by batch.

    fn gets batches of a bounded size with the columns keep + used (its first is
    the text) and returns one array for each field.  A kept column whose name a field has gives way to it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    columns = list(dict.fromkeys([*kept, *used]))
    source = df.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([source.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, columns.index(used[0])):
                yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in kept] + fn(batch), names=schema.names)

    return in_arrow(source, run, schema, keeps)


def filtered(df: DataFrame, text_col: str, fn: Callable[[pa.Array], list[bool]], keeps: str | None = None) -> DataFrame:
    """The rows, with all their columns, for whose text fn says so; it gets texts of a bounded size at once."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(fn(batch.column(at)), pa.bool_()))

    return in_arrow(df, run, df.schema, keeps)


#: DuckDB's memory in a worker; tables are of one slice or shard, so that nothing is spilled to a local folder.
DUCK_MEMORY = "600MB"


@functools.lru_cache(1)
def duck() -> duckdb.DuckDBPyConnection:
    """A worker's DuckDB: one thread for a task's one core, in memory alone."""
    return duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})


def in_duck(sql: str, **tables: pa.Table) -> pa.Table:
    """The rows of a query over Arrow tables, in the worker's DuckDB."""
    con = duck()
    for name, rows in tables.items():
        con.register(name, rows)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        for name in tables:
            con.unregister(name)
