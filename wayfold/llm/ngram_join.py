"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word shingles.  Shingles have one global order:
by the exact number of documents that have them, very common ones last.  A
document of n shingles needs an overlap of at least o = ceil(threshold * n) with
any partner, so two partners share at least l shingles of their prefixes of
length n - o + l: each document takes the l of least estimated cost, from the
lengths of the lists that its prefix would read, and a pair is verified only with
the shared prefix shingles that both l require.

Frequencies come from one shuffle of sorted blocks of shingles: a task has a range of
shingles of all documents and sends back only those that two documents share.
Shingles of one document alone stand first in its prefix and need no list, so a
document whose prefix has no others is done.  Shingles that many documents of one
block of text have are told apart beforehand, sent to all workers and kept out of
that shuffle, so no task gets a hot one.

Equal sets are one class, and only classes are joined.  Components need no pair
whose ends are connected already: each prefix list is first checked against its
most central class, then only the pairs across the components left in a list.
Both steps drop a pair when the shingles before the first shared one leave too
few to reach the threshold, which is exact and holds for hot lists too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._base import dropped, in_arrow, in_groups, slices, written

WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
#: Shingles of a range that one task looks at, about, and the least number of ranges (a power of two).
RANGE_SHINGLES, LEAST_RANGES = 1 << 19, 256
#: Documents of a block of text that make a shingle hot, and hot shingles at most, the commonest (4 MB); others go through the shuffle.
HOT_DOCS, HOT_SHINGLES = 16, 1 << 18
#: Documents of a block of text at most, so that two bytes number them.
BLOCK_DOCS = 50_000
#: Longest l, and the cost of verifying a candidate in list entries read.
LONGEST, VERIFY_COST = 8, 16
#: Document ids up to which the wanted ones are broadcast to the documents (under 64 MB); beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ of all texts, and where each text begins, with the end."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    index = coded.indices.to_numpy()
    offsets = words.offsets.to_numpy().astype(np.int64)
    full = np.fromiter(map(bool, distinct), bool, len(distinct))[index] if len(index) else np.zeros(0, bool)
    edges = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    return table[index][full] if len(index) else np.zeros(0, np.uint64), edges


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, edges = word_hashes(texts)
    power = [np.uint64(pow(int(_ODD), k + 1, 1 << 64)) for k in range(size)]
    n = max(0, len(words) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words[k : k + n] * power[k]
    h = mixed(h)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(h[a : b - size + 1])
        elif b > a:
            own = np.full(1, b - a, np.uint64)
            for k in range(b - a):
                own += words[a + k : a + k + 1] * power[k]
            yield mixed(own)
        else:
            yield np.zeros(0, np.uint64)


def class_of(own: np.ndarray) -> int:
    """64-bit hash of a whole set, signed."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to a bounded size of text and number of documents."""
    for batch in batches:
        for part in slices(batch, column):
            for at in range(0, part.num_rows, BLOCK_DOCS):
                yield part.slice(at, BLOCK_DOCS)


def described(docs: DataFrame) -> DataFrame:
    """Rows (id, n, class) of all documents, and rows (tau, n): shingles that n documents of one block have, n at least HOT_DOCS."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n", "class", "tau"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 1):
            sets = list(shingle_sets(part.column(1)))
            n, classes = [len(own) for own in sets], [class_of(own) if len(own) else None for own in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(len(n), pa.int64())], names=names)
            if len(sets) < HOT_DOCS:
                continue
            tau, count = np.unique(np.concatenate(list(dict(zip(classes, sets, strict=True)).values())), return_counts=True)
            hot = count >= HOT_DOCS
            if hot.any():
                k = int(hot.sum())
                yield pa.RecordBatch.from_arrays([pa.nulls(k, part.column(0).type), pa.array(count[hot]), pa.nulls(k, pa.int64()), pa.array(signed(tau[hot]))], names=names)

    return in_arrow(docs, run, f"id {kind}, n long, class long, tau long")


def hot_shingles(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hot shingles, HOT_SHINGLES at most, and how many documents are known to have each."""
    found = seen.where("tau is not null").groupBy("tau").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "tau").limit(HOT_SHINGLES).toArrow()
    tau, n = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(tau)
    return tau[order], n[order]


def spokesmen(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The documents without those whose sets others of smaller ids have: about one text of each class.

    Rows without an id stay, and all rows of an id of which one is the first of its class.
    """
    first = members.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    again = members.where("id is not null").join(first.where("rows > 1 and least is not null"), "class", "left")
    spare = again.groupBy("id").agg(F.min(F.col("least").isNotNull() & (F.col("id") != F.col("least"))).alias("spare")).where("spare").select(F.col("id").alias("spare_id"))
    spare = written(spare, "spare")
    return docs.join(F.broadcast(spare) if spare.count() <= BROADCAST_IDS else spare, F.col("id") == F.col("spare_id"), "left_anti")


def prefix(n: int, count: np.ndarray, percent: int) -> tuple[int, int, int]:
    """How many of a set's shared shingles its prefix has, its l, and how far it is from central (0 to 31).

    n is the set's size, count the sorted document numbers of the shingles that
    others have too; the others come before.  A prefix of length base + l with l
    at least 1 reads the lists of those of its shingles that are shared.
    """
    alone = n - len(count)
    base = n - (percent * n + 99) // 100
    most = min(LONGEST, n - base)
    sums = np.concatenate(([0], np.cumsum(count)))[np.maximum(0, base + np.arange(1, most + 1) - alone)]  # entries read for l = 1, 2, ...
    cost = sums * (1 + VERIFY_COST / np.arange(1, most + 1))
    best = int(np.argmin(cost)) + 1
    return max(0, base + best - alone), best, 31 - int(min(31, 2 * np.log2(count).sum() / n))


def postings(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], shingles: int, percent: int) -> DataFrame:
    """(tau, class, n, pos from 1, l, far) of the shingles in every set's prefix that another set may have; far is less for more central sets."""
    bits = max(LEAST_RANGES, shingles // RANGE_SHINGLES).bit_length() - 1
    ranges = 1 << bits
    shared = docs.sparkSession.sparkContext.broadcast(hot[0])
    counts = docs.sparkSession.sparkContext.broadcast(hot[1])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (range, block, keys, docs) of a block's shingles, and one row (-, block, heads, hot) on its documents."""
        at, hot_tau, hot_n = TaskContext.get().partitionId() << 32, shared.value, counts.value
        seen: set[int] = set()  # as many as the task has rows
        for part in blocks(batches, 0):
            at += 1
            sets, heads, ends = [], [], []
            for own in shingle_sets(part.column(0)):
                if not len(own) or (c := class_of(own)) in seen:
                    continue
                seen.add(c)
                if len(hot_tau):
                    place = np.minimum(np.searchsorted(hot_tau, own), len(hot_tau) - 1)
                    is_hot = hot_tau[place] == own
                    if is_hot.any():
                        mine = place[is_hot]
                        mine = mine[np.lexsort((mine, hot_n[mine]))]  # the last of the global order: only as many as a prefix can reach
                        room = len(own) - (percent * len(own) + 99) // 100 + LONGEST - (len(own) - len(mine))
                        ends.append(np.stack([np.full(max(0, room), len(heads)), mine[: max(0, room)]]) if room <= len(mine) else np.stack([np.full(len(mine), len(heads)), mine]))
                        heads.append((c, len(own), len(mine)))
                        sets.append(own[~is_hot])
                        continue
                heads.append((c, len(own), 0))
                sets.append(own)
            if not heads:
                continue
            tail = np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            tau = np.concatenate(sets)
            order = np.argsort(tau, kind="stable")
            tau, doc = tau[order], doc[order]
            cut = np.searchsorted(tau, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(tau)]
            full = [r for r in range(ranges) if cut[r + 1] > cut[r]]
            keys = [tau[cut[r] : cut[r + 1]].tobytes() for r in full]
            docs_of = [doc[cut[r] : cut[r + 1]].tobytes() for r in full]
            full.append(ranges + at % ranges)
            keys.append(np.array(heads, np.int64).tobytes())
            docs_of.append(tail.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([at] * len(full), pa.int64()), pa.array(keys, pa.binary()), pa.array(docs_of, pa.binary())], names=["range", "block", "keys", "docs"])

    def met(rows: pa.Table) -> pa.Table:
        """Of a range: for each block the shingles that another document has, their documents and document numbers."""
        if rows.column("range")[0].as_py() >= ranges:
            return pa.table([rows.column("block"), rows.column("keys"), rows.column("docs"), pa.nulls(rows.num_rows, pa.binary())], names=["block", "keys", "docs", "counts"])
        blobs = rows.column("keys").to_pylist()
        size = np.array([len(x) // 8 for x in blobs])
        tau = np.frombuffer(b"".join(blobs), np.uint64)
        doc = np.frombuffer(b"".join(rows.column("docs").to_pylist()), np.uint16)
        order = np.argsort(tau, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], tau[order][1:] != tau[order][:-1])))
        many = np.diff(np.concatenate((edge, [len(tau)])))
        count = np.empty(len(tau), np.uint32)
        count[order] = np.repeat(many, many)
        own = count > 1
        keep = np.split(own, np.cumsum(size)[:-1])
        out = ([], [], [], [])
        at = 0
        for block, k in zip(rows.column("block").to_pylist(), keep, strict=True):
            if k.any():
                mine = at + np.flatnonzero(k)
                out[0].append(block)
                out[1].append(tau[mine].tobytes())
                out[2].append(doc[mine].tobytes())
                out[3].append(count[mine].tobytes())
            at += len(k)
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "keys", "docs", "counts"])

    def gathered(rows: pa.Table) -> pa.Table:
        """Of a block: the prefixes of its documents."""
        parts = list(zip(*(rows.column(c).to_pylist() for c in ("keys", "docs", "counts")), strict=True))
        heads, tail = next((k, d) for k, d, c in parts if c is None)
        heads, tail = np.frombuffer(heads, np.int64).reshape(-1, 3), np.frombuffer(tail, np.int32).reshape(2, -1).astype(np.int64)
        parts = [p for p in parts if p[2] is not None]
        tau = np.concatenate([np.frombuffer(b"".join(p[0] for p in parts), np.uint64), shared.value[tail[1]]])
        doc = np.concatenate([np.frombuffer(b"".join(p[1] for p in parts), np.uint16).astype(np.int64), tail[0]])
        known = np.frombuffer(b"".join(p[2] for p in parts), np.uint32).astype(np.int64)
        count = np.concatenate([known, counts.value[tail[1]]])
        is_hot = np.concatenate([np.zeros(len(known), bool), np.ones(len(tail[0]), bool)])
        order = np.lexsort((tau, count, is_hot, doc))
        tau, doc, count, is_hot = tau[order], doc[order], count[order], is_hot[order]
        edge = np.searchsorted(doc, np.arange(len(heads) + 1)).tolist()
        keep, info = [], []
        for d, (c, n, hots) in enumerate(heads.tolist()):
            a, b = edge[d], edge[d + 1]
            if a == b:
                continue
            left = hots - int(is_hot[a:b].sum())  # hot ones that no prefix reaches
            own = np.concatenate([count[a:b], np.full(left, count[b - 1])]) if left else count[a:b]
            reach, best, far = prefix(n, own, percent)
            reach = min(reach, b - a)
            if reach:
                keep.append(np.arange(a, a + reach))
                info.append((c, n, n - len(own) + 1, best, far, reach))
        if not keep:
            return pa.table([pa.array([], pa.int64())] * 6, names=["tau", "class", "n", "pos", "l", "far"])
        at = np.concatenate(keep)
        c, n, start, best, far, size = (np.array(x, np.int64) for x in zip(*info, strict=True))
        pos = np.repeat(start, size) + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return pa.table([pa.array(signed(tau[at])), *(pa.array(np.repeat(x, size)) for x in (c, n)), pa.array(pos), *(pa.array(np.repeat(x, size)) for x in (best, far))], names=["tau", "class", "n", "pos", "l", "far"])

    rows = in_arrow(docs.select("text"), dealt, "range int, block long, keys binary, docs binary")
    back = in_groups(rows, ["range"], met, "block long, keys binary, docs binary, counts binary")
    return in_groups(back, ["block"], gathered, "tau long, class long, n long, pos long, l long, far long")


def listed(entries: DataFrame) -> DataFrame:
    """Entries of lists with two classes at least, and their list's head: its most central class.

    Entries are dealt by shingle and class, so a long list is spread over tasks; one row for each list joins them.
    """
    # n: 28 bits, pos: 26, l: 4, far: 5
    packed = entries.select("tau", "class", F.expr("shiftleft(far, 58) | shiftleft(l, 54) | shiftleft(pos, 28) | n").alias("meta"))
    own = written(packed.groupBy("tau", "class").agg(F.min("meta").alias("meta")), "entries")
    heads = own.groupBy("tau").agg(F.min(F.struct("meta", "class")).alias("head"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("tau", "head")
    part = lambda meta: [F.expr(f"{meta} & 268435455"), F.expr(f"shiftright({meta}, 28) & 67108863"), F.expr(f"shiftright({meta}, 54) & 15")]
    n, pos, l = part("meta")
    head_n, head_pos, head_l = part("head.meta")
    return own.join(heads, "tau").select("tau", "class", n.alias("n"), pos.alias("pos"), l.alias("l"), F.col("head.class").alias("head"), head_n.alias("head_n"), head_pos.alias("head_pos"), head_l.alias("head_l"))


def required(percent: int, n: str, m: str, l: str, k: str):
    """Shared prefix shingles without which sizes n and m, with prefixes for l and k, can't reach the threshold.

    Shared shingles up to the end of the prefix that ends first are in both
    prefixes; behind it that document has o - l shingles left.
    """
    o = lambda x: f"((({percent}) * {x} + 99) div 100)"
    return F.expr(f"greatest(least({l}, {k}), (({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}) - greatest({o(n)} - {l}, {o(m)} - {k}))")


def promising(percent: int, n: str, m: str, bound: str):
    """Sizes n and m can reach the threshold with an overlap of at most bound."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {percent} * ({n} + {m}) <= {100 + percent} * ({bound})")


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = written(members.join(ends, "class").groupBy("class").agg(F.min("id").alias("id")).select(F.col("id").alias("wanted")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                own = [s for s in shingle_sets(part.column(0)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["class", "own"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = in_arrow(chosen.select("text"), sets, "class long, own binary")
    left, right = known.select(F.col("class").alias("a"), F.col("own").alias("x")), known.select(F.col("class").alias("b"), F.col("own").alias("y"))
    return in_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(class, comp) of every class with a link; comp is the smallest class reachable.

    Each round takes the smallest label around a class, then the label of that
    label; rounds grow with the logarithm of a component's length.
    """
    both = written(links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels["class"]).groupBy(F.col("a").alias("class")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "class").select("class", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        # what a label's own class has learned holds for all with that label
        root = low.groupBy(F.col("old").alias("root")).agg(F.min("low").alias("best"))
        jump = labels.select(F.col("class").alias("root2"), F.col("comp").alias("up"))
        new = low.join(root, low.old == root.root).select("class", "old", F.least("low", "best").alias("comp"))
        new = new.join(jump, new.comp == jump.root2, "left").select("class", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        new = written(new, "labels")
        labels = new.select("class", "comp")
        if not new.where("old <> comp").limit(1).count():
            return labels


def links(docs: DataFrame, members: DataFrame, hot: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Verified pairs of classes that connect every component, and its components; no pair is lost between components."""
    one = spokesmen(docs, members)
    shingles = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lists = written(listed(postings(one, hot, shingles, percent)), "lists")
    # shingles before the first that any other prefix has can't be shared, and no more of a prefix than are in lists
    own = Window.partitionBy("class")
    lists = lists.withColumns({"cap": F.max(F.expr("n - pos + 1")).over(own), "most": F.count("*").over(own), "place": F.row_number().over(own.orderBy("pos"))})
    stars = (
        lists.where(F.col("class") != F.col("head")).where(promising(percent, "n", "head_n", "cap"))
        .groupBy(F.col("class").alias("a"), F.col("head").alias("b"))
        .agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("head_n").alias("m"), F.least(F.first("l"), F.first("head_l")).alias("least"),
             F.least(F.max(F.expr("n - pos + 1")), F.max(F.expr("head_n - head_pos + 1"))).alias("bound"))
        .where("shared >= least").where(promising(percent, "n", "m", "bound")).select("a", "b")
    )
    first = written(verified(written(stars, "stars"), docs, members, percent), "linked")
    comps = components(first)
    of_class, of_head = comps.select("class", F.col("comp").alias("own_comp")), comps.select(F.col("class").alias("head"), F.col("comp").alias("its_comp"))
    placed = (
        lists.join(of_class, "class", "left").join(of_head, "head", "left")
        .select("tau", "class", "n", "pos", "l", "cap", "most", "place", F.coalesce("own_comp", "class").alias("comp"), F.coalesce("its_comp", "head").alias("main"))
    )
    placed = written(placed, "placed")
    a, b = placed.where("comp <> main").alias("a"), placed.alias("b")
    need = required(percent, "a.n", "b.n", "a.l", "b.l")
    # the first shared shingle has need - 1 more behind it in both prefixes: later places can't propose a pair
    early = F.least(F.col("a.most") - F.col("a.place"), F.col("b.most") - F.col("b.place")) >= need - 1
    proposed = written(
        a.join(b, (F.col("a.tau") == F.col("b.tau")) & (F.col("a.comp") != F.col("b.comp")) & ((F.col("b.comp") == F.col("b.main")) | (F.col("a.class") < F.col("b.class")))
               & promising(percent, "a.n", "b.n", "least(a.cap, b.cap)") & early)
        .select(F.least("a.class", "b.class").alias("a"), F.greatest("a.class", "b.class").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"),
                need.alias("least"), F.greatest(F.expr("a.n - a.pos + 1"), F.expr("b.n - b.pos + 1")).alias("left"))
        .groupBy("a", "b").agg(F.first(F.struct("n", "m", "least")).alias("s"), F.max("left").alias("bound"))
        .where(promising(percent, "s.n", "s.m", "bound")).select("a", "b", F.col("s.least").alias("least")), "proposed")
    ends = proposed.select(F.col("a").alias("class")).union(proposed.select("b")).distinct()
    prefixes = lists.join(ends, "class", "left_semi").groupBy("class").agg(F.collect_list("tau").alias("taus"))
    left, right = prefixes.select(F.col("class").alias("a"), F.col("taus").alias("x")), prefixes.select(F.col("class").alias("b"), F.col("taus").alias("y"))
    across = proposed.join(left, "a").join(right, "b").where(F.size(F.array_intersect("x", "y")) >= F.col("least")).select("a", "b")
    across = written(across.join(first, ["a", "b"], "left_anti"), "across")
    if not across.limit(1).count():
        return first, comps
    return first.union(verified(across, docs, members, percent)), None


def join_ngrams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets.
    Null, empty and wordless texts have no shingles and link with nothing, fewer
    words than a shingle's are one shingle.  Rows of one id count as one document
    with several texts: what either links with is connected.  Rows without an id
    connect others but have no component of their own to name; theirs is that of
    the documents they link with, or null.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    seen = written(described(docs), "described")
    members = seen.where("tau is null").select("id", "n", "class")
    found, comps = links(docs, members.where("class is not null"), hot_shingles(seen), percent)
    repeated = members.where("id is not null and class is not null").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("id", "a")
    twice = members.join(repeated, "id").where("class <> a").select("a", F.col("class").alias("b"))
    if comps is None or twice.limit(1).count():
        comps = components(found.union(twice))
    named = members.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    named = written(named, "named")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    return named.join(least, "comp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def without_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of which each component keeps the one with the smallest id, with all their columns.

    Of rows that share an id the smallest stays.  Rows without an id stay.
    """
    one, again, rows_of = (f"wayfold_{x}_{uuid.uuid4().hex}" for x in ("id", "again", "row"))  # names that no table has
    placed = written(join_ngrams(docs, id_col=id_col, text_col=text_col, percent=percent).where(F.col(f"`{id_col}`").isNotNull()), "placed")
    repeated = placed.groupBy(F.col(f"`{id_col}`").alias(one)).agg(F.count("*").alias("rows"), F.max(F.col("component_id") == F.col(f"`{id_col}`")).alias("first"))
    gone = written(repeated.where("not first or rows > 1").select(one, F.col("first").alias(again)), "gone")
    few = gone.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, F.col(f"`{id_col}`") == F.col(one), "left_anti")
    twice = gone.where(again).select(one)
    if twice.limit(1).count():
        rows = docs.join(F.broadcast(twice) if few else twice, F.col(f"`{id_col}`") == F.col(one), "left_semi")
        least = rows.groupBy(F.col(f"`{id_col}`").alias(one)).agg(F.min(F.struct(*[f"`{c}`" for c in docs.columns])).alias(rows_of))
        out = out.unionByName(least.select(f"{rows_of}.*"))
    return out
