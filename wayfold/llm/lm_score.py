"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised on a logarithmic scale; an n-gram
of level q is inserted as the keys (n-gram, 1) ... (n-gram, q), and a count is
read back by probing keys until one is missing.

N-grams are counted by ranges of their hashes: each block of text sends its
sorted distinct ones, with counts, to the tasks of their ranges, and a task also
makes the filter's segment of its range, half full.  A filter up to
BROADCAST_BYTES goes to all workers, who score in one pass.  Beyond that the
blocks' distinct n-grams go to the segments as they went to be counted, and
their levels come back; the results are the same.

P(w | h) = (c(h w) + PAIR_PRIOR * P(w)) / (c(h) + PAIR_PRIOR + false), P(w) = (c(w) + 1) / (N + V + 1),
with counts read at the lower end of their level and c(h) at the upper.  false is
the mass that wrongly found pairs are expected to get: V times the share of
unseen pairs that pass all probes.  The probes grow with the logarithm of V, so
it stays under FALSE_SHARE of the prior, and probabilities over all words sum to
one at most in expectation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm._base import dropped, in_arrow, in_groups, slices, written
from wayfold.llm.ngram_join import mixed, word_hashes

#: Steps of a level: counts grow by 2 ** (1 / STEPS) from level to level.
STEPS = 2
#: N-grams that one task looks at, about, and the least number of ranges of each order (a power of two).
RANGE_TOKENS, LEAST_RANGES = 1 << 19, 128
#: Probes of a level after the first: what they wrongly say changes a count by one level only.
LATER_PROBES = 7
#: False mass for a history at most, as a share of PAIR_PRIOR, and least probes of the first level.
FALSE_SHARE, LEAST_PROBES = 0.01, 14
#: A filter of so many bytes at most is sent to all workers.
BROADCAST_BYTES = 256 << 20
#: Weight of the word distribution in that of pairs.
PAIR_PRIOR = 300.0
#: Words with exact counts that are broadcast, the commonest (16 MB); the others meet their counts in a join.
HEAD_WORDS = 1_000_000
#: Text that a worker looks at in one go: a dozen arrays of its words take some 20 times as much.
TEXT_BYTES = 6 << 20

END_WORD = np.uint64(0xA0761D6478BD642F)
WORD, PAIR = 0, 1


def level_starts() -> np.ndarray:
    """Smallest count of each level, from level 1."""
    raw = np.ceil(2 ** (np.arange(0, 40 * STEPS) / STEPS) - 1e-9)
    return np.unique(raw).astype(np.int64)


STARTS = level_starts()


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(STARTS, counts, side="right")


def low_count(level: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], STARTS))[level]


def high_count(level: np.ndarray) -> np.ndarray:
    """Largest count of a level; 0 for level 0."""
    return np.concatenate(([0], STARTS[1:] - 1, [STARTS[-1]]))[level]


def word_keys(words: np.ndarray) -> np.ndarray:
    return mixed(words + np.uint64(7))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, an end after each text, and where each text begins, with the end."""
    words, edges = word_hashes(texts)
    size = np.diff(edges)
    out = np.full(len(words) + len(size), END_WORD, np.uint64)
    at = np.ones(len(out), bool)
    edges = np.concatenate(([0], np.cumsum(size + 1)))
    at[edges[1:] - 1] = False
    out[at] = words
    return out, edges


def histories(words: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The word before each; the end stands before a text's first."""
    before = np.concatenate(([END_WORD], words[:-1]))
    before[edges[:-1]] = END_WORD
    return before


def cuts(keys: np.ndarray, bits: int) -> list[int]:
    """Where the ranges of the highest bits begin in sorted keys, with the end."""
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]


def by_range(keys: np.ndarray, bits: int, order: int, *others: np.ndarray) -> Iterator[tuple]:
    """(range of this order, bytes of the keys and others in it) for sorted keys."""
    cut = cuts(keys, bits)
    for r in range(1 << bits):
        if cut[r + 1] > cut[r]:
            yield (order << bits) + r, *(x[cut[r] : cut[r + 1]].tobytes() for x in (keys, *others))


def counted(texts: DataFrame, bits: int) -> DataFrame:
    """(part, keys, counts, n, total, later) of words and pairs in a one-column table of texts: one row for each range.

    keys are sorted uint64, counts uint32, n distinct, total their sum, later how many keys of levels after the first they make.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, TEXT_BYTES):
                words, edges = tokens(part.column(0))
                for order, keys in ((WORD, word_keys(words)), (PAIR, pair_keys(histories(words, edges), words))):
                    key, n = np.unique(keys, return_counts=True)
                    rows = list(zip(*by_range(key, bits, order, n.astype(np.uint32)), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["part", "keys", "counts"])

    def merged(rows: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, counts = keys[edge], np.add.reduceat(counts, edge)
        later = int((levels(counts) - 1).sum())
        own = [rows.column("part")[0].as_py(), keys.tobytes(), counts.tobytes(), len(keys), int(counts.sum()), later]
        return pa.table([pa.array([x], t) for x, t in zip(own, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "keys", "counts", "n", "total", "later"])

    return in_groups(in_arrow(texts, run, "part int, keys binary, counts binary"), ["part"], merged, "part int, keys binary, counts binary, n long, total long, later long")


def probes_for(distinct: int) -> int:
    """Probes of the first level that keep the false mass of a half-full filter under FALSE_SHARE of the prior."""
    return max(LEAST_PROBES, math.ceil(math.log2(max(1, distinct) / (FALSE_SHARE * PAIR_PRIOR))))


def places(keys: np.ndarray, level: int, probes: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bit of each probe of (key, level) in a segment of size bits, under 2 ** 32."""
    h = mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    low = np.uint64(0xFFFFFFFF)
    a, b, size = h & low, (h >> np.uint64(32)) | np.uint64(1), np.asarray(size, np.uint64)
    for _ in range(probes):
        yield (a * size) >> np.uint64(32)
        a = (a + b) & low


def segment(keys: np.ndarray, level: np.ndarray, probes: int) -> np.ndarray:
    """Bits of one range's filter, of a size that they half fill."""
    keys_set = len(keys) * probes + int((level - 1).sum()) * LATER_PROBES
    size = max(64, -(-int(keys_set / math.log(2)) // 8) * 8)
    bits = np.zeros(size, bool)
    for q in range(1, len(STARTS) + 1):
        mine = level >= q
        keys, level = keys[mine], level[mine]
        if not len(keys):
            break
        for place in places(keys, q, probes if q == 1 else LATER_PROBES, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little")


def built(counts: DataFrame, probes: int) -> DataFrame:
    """(part, bits, filled): the segment of each range, and the share of its bits that are set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, n = np.frombuffer(batch.column(1)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(2)[k].as_buffer(), np.int64)
                bits = segment(keys, levels(n), probes)
                filled = float(np.bitwise_count(bits).sum()) / (8 * len(bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([bits.tobytes()], pa.binary()), pa.array([filled])], names=["part", "bits", "filled"])

    return written(in_arrow(counts.select("part", "keys", "counts"), run, "part int, bits binary, filled double"), "segments")


def count_level(bits: np.ndarray, first: np.ndarray | int, size: np.ndarray | int, keys: np.ndarray, probes: int) -> np.ndarray:
    """Level of each key by probes until one fails; its segment is size bits from byte first on, size 0 where it has none."""
    level = np.zeros(len(keys), np.uint8)
    first, size = np.broadcast_to(first, keys.shape), np.broadcast_to(np.asarray(size, np.uint64), keys.shape)
    live = np.flatnonzero(size > 0)
    for q in range(1, len(STARTS) + 1):
        if not live.size:
            break
        h, base, room, there, keep = keys[live], first[live], size[live], live, None
        # few of the unseen outlive the first probes: look at those alone from then on
        h = mixed(h + np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        for k in range(probes if q == 1 else LATER_PROBES):
            at = (a * room) >> np.uint64(32)
            ok = (bits[base + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            a = (a + b) & np.uint64(0xFFFFFFFF)
            if k < 6:
                if not ok.all():
                    there, base, room, a, b = there[ok], base[ok], room[ok], a[ok], b[ok]
            else:
                keep = ok if keep is None else keep & ok
        live = there if keep is None else there[keep]
        level[live] = q
    return level


class Filter:
    """All segments in a row; bits may be empty where a range has no n-grams."""

    def __init__(self, bits: np.ndarray, first: np.ndarray, size: np.ndarray, range_bits: int, probes: int) -> None:
        self.bits, self.first, self.size, self.range_bits, self.probes = bits, first, size, range_bits, probes

    def level(self, keys: np.ndarray, order: int) -> np.ndarray:
        part = (order << self.range_bits) + (keys >> np.uint64(64 - self.range_bits)).astype(np.int64)
        return count_level(self.bits, self.first[part], self.size[part], keys, self.probes)


def whole(segments: DataFrame, range_bits: int, probes: int) -> Filter:
    """The filter on the driver, BROADCAST_BYTES at most."""
    first, size = np.zeros(2 << range_bits, np.int64), np.zeros(2 << range_bits, np.uint64)
    for r in segments.select("part", F.octet_length("bits").alias("n")).collect():  # a row for each range
        size[r.part] = 8 * r.n
    first[1:] = np.cumsum(size // np.uint64(8))[:-1]
    bits = np.zeros(int(size.sum()) // 8, np.uint8)
    for r in segments.select("part", "bits").toLocalIterator():
        bits[first[r.part] : first[r.part] + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits, first, size, range_bits, probes)


def head_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and counts of the commonest words, all from a least count on, and that count."""
    by = words.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).toLocalIterator()
    total, least = 0, 1 << 62
    for r in by:  # a row for each step of the logarithm, at most some thousands
        total += r.words
        if total > HEAD_WORDS:
            break
        least = r.least
    rows = words.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order], least


class Block:
    """Distinct words and pairs of a block of texts, and where each token finds its own."""

    def __init__(self, texts: pa.Array) -> None:
        word, self.edges = tokens(texts)
        self.pairs, self.pair_at = np.unique(pair_keys(histories(word, self.edges), word), return_inverse=True)
        self.words, self.word_at = np.unique(word_keys(word), return_inverse=True)

    def packed(self) -> list[bytes]:
        return [self.edges.astype(np.int64).tobytes(), self.words.tobytes(), self.word_at.astype(np.uint32).tobytes(), self.pair_at.astype(np.uint32).tobytes()]

    @classmethod
    def unpacked(cls, edges: bytes, words: bytes, word_at: bytes, pair_at: bytes) -> Block:
        own = cls.__new__(cls)
        own.edges, own.words = np.frombuffer(edges, np.int64), np.frombuffer(words, np.uint64)
        own.word_at, own.pair_at = np.frombuffer(word_at, np.uint32), np.frombuffer(pair_at, np.uint32)
        return own

    def scores(self, word_level: np.ndarray, pair_level: np.ndarray, tokens_all: float, false: float) -> np.ndarray:
        """log10 probability of each text, from the levels of its distinct words and pairs."""
        single = word_level[self.word_at]
        before = np.concatenate((single[-1:], single[:-1]))
        before[self.edges[:-1]] = single[self.edges[1:] - 1]  # the end stands before a text's first word
        p = (low_count(single) + 1) / tokens_all
        p = (low_count(pair_level[self.pair_at]) + PAIR_PRIOR * p) / (high_count(before) + PAIR_PRIOR + false)
        return np.add.reduceat(np.log10(p), self.edges[:-1])

    def known(self, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text: tokens among the head words, the sum of their log10(count + 1), and the keys of its other tokens."""
        keys, counts = head
        if len(keys):
            at = np.minimum(np.searchsorted(keys, self.words), len(keys) - 1)
            found = keys[at] == self.words
            logs = np.where(found, np.log10(counts[at] + 1), 0)
        else:
            found, logs = np.zeros(len(self.words), bool), np.zeros(len(self.words))
        mine = found[self.word_at]
        sums = np.concatenate(([0], np.cumsum(mine)))[self.edges]
        other = self.words.view(np.int64)[self.word_at[~mine]]
        cut = np.concatenate(([0], np.cumsum(~mine)))[self.edges]
        return np.diff(sums), np.add.reduceat(logs[self.word_at], self.edges[:-1]), [other[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document: id_col, n_tokens, n_known, train_tokens, base_score, score.

    training says of the columns id and text whether a row is learned from; null
    is no.  base_score is the add-one word model's log10 probability from exact
    counts, score the pair model's from the filter's.  Null and empty texts are
    an end alone.  Repeated rows count and are scored each for itself.  Without
    training rows every token has probability 1 under both.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    taught = own.where(training).select("text")
    size = taught.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(LEAST_RANGES, size // 6 // RANGE_TOKENS).bit_length() - 1  # a word has about six bytes
    counts = written(counted(taught, bits), "ngrams")
    sums = {r.order: r for r in counts.groupBy(F.shiftright("part", bits).alias("order")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("later").alias("later")).collect()}
    total, distinct = (sums[WORD].total, sums[WORD].n) if sums else (0, 0)
    probes = probes_for(distinct)
    segments = built(counts, probes)
    filter_bytes = sum(r.n * probes + r.later * LATER_PROBES for r in sums.values()) / math.log(2) / 8
    passing = segments.where(F.shiftright("part", bits) == PAIR).agg(F.avg(F.pow("filled", F.lit(probes)))).first()[0] or 0.0
    false = distinct * passing

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys.as_buffer(), np.int64)), pa.array(np.frombuffer(n.as_buffer(), np.int64))], names=["key", "n"])

    words = in_arrow(counts.where(F.shiftright("part", bits) == WORD).select("keys", "counts"), opened, "key long, n long")
    head, head_n, least = head_words(words)
    shared_head = spark.sparkContext.broadcast((head, head_n))
    tokens_all = total + distinct + 1
    kind = own.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_tokens long, head_known long, head_score double, rare array<long>, score double"

    def described(row: int, ids: pa.Array, block: Block, word_level: np.ndarray, pair_level: np.ndarray) -> pa.RecordBatch:
        known, logs, rare = block.known(shared_head.value)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + len(ids))), ids, pa.array(np.diff(block.edges)), pa.array(known), pa.array(logs), pa.array(rare, pa.list_(pa.int64())), pa.array(block.scores(word_level, pair_level, tokens_all, false))],
            names=["row", "id", "n_tokens", "head_known", "head_score", "rare", "score"],
        )

    if filter_bytes <= broadcast_bytes:
        shared = spark.sparkContext.broadcast(whole(segments, bits, probes))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lookup, row = shared.value, TaskContext.get().partitionId() << 40
            for batch in batches:
                for part in slices(batch, 1, TEXT_BYTES):
                    block = Block(part.column(1))
                    yield described(row, part.column(0), block, lookup.level(block.words, WORD), lookup.level(block.pairs, PAIR))
                    row += part.num_rows

        state = written(in_arrow(own, scored, schema), "scored")
        shared.unpersist()
    else:
        state = written(_routed(own, segments, bits, probes, described, schema), "scored")
    dropped(segments)

    tail = words.where(F.col("n") < least).select(F.col("key").alias("rare"), "n")
    rare = state.select("row", F.explode("rare").alias("rare"))
    of_rare = rare.join(tail, "rare").groupBy("row").agg(F.count("*").alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    return state.join(of_rare, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens_all)))).alias("base_score"), "score",
    )


def _routed(own: DataFrame, segments: DataFrame, range_bits: int, probes: int, described, schema: str) -> DataFrame:
    """Scores with a filter too large for one worker: the blocks' n-grams go to its segments, their levels come back.

    Rows of the first shuffle are a segment's bits, a block's keys in a range, or a block's own description, which passes through.
    """
    parts = 2 << range_bits
    kind = own.schema["id"].dataType
    fields = "part int, block long, keys binary, head array<binary>, ids array<" + kind.simpleString() + ">"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 20
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                at += 1
                block = Block(part.column(1))
                rows = [*by_range(block.words, range_bits, WORD), *by_range(block.pairs, range_bits, PAIR)]
                n = len(rows)
                ids = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows] + [parts + at % parts], pa.int32()), pa.array([at] * (n + 1)), pa.array([r[1] for r in rows] + [None], pa.binary()), pa.array([None] * n + [block.packed()], pa.list_(pa.binary())), ids],
                    names=["part", "block", "keys", "head", "ids"],
                )

    def answered(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        if part >= parts:
            return rows.drop_columns(["bits"])
        mine = rows.column("bits").combine_chunks()
        have = np.flatnonzero(np.asarray(mine.is_valid()))
        bits = np.frombuffer(mine[int(have[0])].as_buffer(), np.uint8) if len(have) else np.zeros(0, np.uint8)
        rest = rows.filter(rows.column("bits").is_null())
        blobs = rest.column("keys").to_pylist()
        level = count_level(bits, 0, 8 * len(bits), np.frombuffer(b"".join(blobs), np.uint64), probes)
        edge = np.cumsum([0] + [len(x) // 8 for x in blobs]).tolist()
        found = pa.array([level[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
        return rest.drop_columns(["bits"]).set_column(2, "keys", found)

    def gathered(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        head = rows.num_rows - 1  # the description's part is the largest
        block = Block.unpacked(*rows.column("head")[head].as_py())
        level = np.frombuffer(b"".join(rows.column("keys").slice(0, head).to_pylist()), np.uint8)
        ids = rows.column("ids").combine_chunks()[head].values
        return pa.Table.from_batches([described(rows.column("block")[0].as_py() << 22, ids, block, level[: len(block.words)], level[len(block.words) :])])

    asks = in_arrow(own, asked, fields).withColumn("bits", F.lit(None).cast("binary"))
    have = segments.select("part", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("array<binary>").alias("head"), F.lit(None).cast(f"array<{kind.simpleString()}>").alias("ids"), "bits")
    answers = in_groups(asks.unionByName(have), ["part"], answered, fields)
    return in_groups(answers, ["block"], gathered, schema)
