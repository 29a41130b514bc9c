"""Training-order materialisation of token ids.

Documents are tokenised and cut into sequences of one length.  A keyed Feistel
permutation of the sequences' numbers, cycle-walking inside their range, gives
each a global slot; slots are dealt by range to shards, each a file of
fixed-stride little-endian uint16 records in slot order.  Slot s lies in shard
s div shard_rows at byte (s mod shard_rows) * 2 * length, so a reader resumes at
any slot, and the inverse permutation tells which sequence it holds.

Every record ends with the end id.  Spark's text writer puts its two bytes after
each record as the line separator, so the files hold the records and nothing
else, and Spark's commit protocol makes each whole or absent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm._base import dropped, in_arrow, shared_path, slices, written
from wayfold.llm.ngram_join import mixed
from wayfold.llm.packing import tokenizer_ids

LENGTH, SHARD_ROWS, END_ID, PAD_ID, ROUNDS = 2048, 4096, 1, 0, 6


class Permutation:
    """A keyed permutation of 0 ... n - 1."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ (mixed(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & self.mask)
        return left << self.half | right

    def walk(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Slots of numbers, or numbers of slots: the permutation of a power of four, again until inside."""
        y = self.once(np.asarray(x, np.uint64), back)
        while (out := np.flatnonzero(y >= np.uint64(self.n))).size:
            y[out] = self.once(y[out], back)
        return y.astype(np.int64)


def sequences(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(part, at, ids): records of an input partition's documents, each followed by the end id, one after the other.

    A record holds length - 1 ids of that stream and the end id; the last of a
    partition is padded.  Null and empty texts are an end id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, at, rest = tokenizer_ids(tokenizer_path), TaskContext.get().partitionId(), 0, np.zeros(0, np.uint16)

        def rows(stream: np.ndarray, n: int) -> pa.RecordBatch:
            body = np.full((n, length), END_ID, "<u2")
            body[:, :-1] = stream.reshape(n, length - 1)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(np.arange(at, at + n)), pa.array([r.tobytes() for r in body], pa.binary())], names=["part", "at", "ids"])

        for batch in batches:
            for some in slices(batch, 0):
                own, edges = ids.of(some.column(0))
                if len(own) and int(own.max()) > 0xFFFF:
                    raise ValueError("the tokenizer's ids don't fit 16 bits")
                stream = np.concatenate([rest, np.insert(own.astype(np.uint16), edges[1:], END_ID)])
                n = len(stream) // (length - 1)
                if n:
                    yield rows(stream[: n * (length - 1)], n)
                    at += n
                rest = stream[n * (length - 1) :]
        if len(rest):
            yield rows(np.concatenate([rest, np.full(length - 1 - len(rest), PAD_ID, np.uint16)]), 1)

    return in_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), run, "part int, at long, ids binary", "tokenizer")


def materialise(docs: DataFrame, tokenizer_path: str, path: str | None = None, *, text_col: str = "text", length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = 20_240_229) -> str:
    """Writes shards under path/shard=K and path/manifest; returns path (one in the shared folder by default).

    Sequences are numbered by input partition, then by place in it; each input
    partition ends in a padded sequence.  Repeated rows are written each for
    itself.  An empty table writes a manifest of no sequences.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    staged = written(sequences(docs, tokenizer_path, text_col=text_col, length=length), "sequences")
    parts = staged.groupBy("part").agg(F.count("*").alias("rows")).toArrow()  # a row for each input partition
    rows = np.zeros(max(parts.column(0).to_pylist(), default=-1) + 1, np.int64)
    rows[parts.column(0).to_numpy()] = parts.column(1).to_numpy()
    n = int(rows.sum())
    if n:
        order = Permutation(n, key)
        first = spark.sparkContext.broadcast(np.cumsum(rows) - rows)  # eight bytes for each input partition

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    slot = order.walk(first.value[batch.column(0).to_numpy()] + batch.column(1).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard_rows), batch.column(2)], names=["slot", "shard", "ids"])

        dealt = in_arrow(staged, placed, "slot long, shard long, ids binary").repartition(F.col("shard")).sortWithinPartitions("shard", "slot")
        # Spark's cast and text writer keep bytes as they are (tried on 4.1; the round-trip test tells)
        record = F.substring(F.col("ids"), 1, 2 * (length - 1)).cast("string")
        end = END_ID.to_bytes(2, "little").decode()
        dealt.select("shard", record.alias("value")).write.partitionBy("shard").option("lineSep", end).option("maxRecordsPerFile", 0).text(path)  # one file a shard, whatever the session says
    dropped(staged)
    facts = {"sequences": n, "length": length, "shard_rows": shard_rows, "key": key, "rounds": ROUNDS, "end_id": END_ID, "pad_id": PAD_ID, "type": "<u2"}
    spark.range(1).select(F.lit(json.dumps(facts)).alias("value")).coalesce(1).write.text(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_sequences(spark: SparkSession, path: str, first_slot: int = 0, last_slot: int | None = None) -> DataFrame:
    """(slot, shard, number, ids) of the slots from first_slot to before last_slot.

    Only the folders of the shards that hold these slots are listed and read; an
    empty range reads none.  Each of these shards must be one file of the records
    that the manifest gives it, else an error is raised: at once for a missing shard
    or another number of files or bytes, by the task for a shard of another size.
    """
    facts = manifest(spark, path)
    n, rows, stride = facts["sequences"], facts["shard_rows"], 2 * facts["length"]
    schema = "slot long, shard long, number long, ids binary"
    last = n if last_slot is None else min(n, last_slot)
    if first_slot >= last:
        return spark.createDataFrame([], schema)
    order = Permutation(n, facts["key"])

    def records(shard: int) -> int:
        return min(rows, n - shard * rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                if len(data) != stride * records(shard):
                    raise ValueError(f"shard {shard} has {len(data)} bytes, the manifest {records(shard)} records of {stride}")
                slot = shard * rows + np.arange(len(data) // stride)
                keep = np.flatnonzero((slot >= first_slot) & (slot < last))
                ids = [data[k * stride : (k + 1) * stride].to_pybytes() for k in keep.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(slot[keep]), pa.array([shard] * len(keep), pa.int64()), pa.array(order.walk(slot[keep], back=True)), pa.array(ids, pa.binary())], names=["slot", "shard", "number", "ids"])

    shard = F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("long")
    low, high = first_slot // rows, (last - 1) // rows
    wanted = [f"{path}/shard=*"] if low == 0 and high == (n - 1) // rows else [f"{path}/shard={k}" for k in range(low, high + 1)]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(wanted)
    there = files.select(shard.alias("shard"), "length").agg(F.count("*"), F.countDistinct("shard"), F.coalesce(F.sum("length"), F.lit(0))).first()  # lists, opens nothing
    expected = (high - low + 1, high - low + 1, stride * (min(n, (high + 1) * rows) - low * rows))
    if tuple(there) != expected:
        raise ValueError(f"shards {low} to {high} of {path}: files, shards and bytes are {tuple(there)}, by the manifest {expected}")
    return in_arrow(files.select(shard.alias("shard"), "content"), cut, schema)
