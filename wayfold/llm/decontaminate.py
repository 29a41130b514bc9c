"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of consecutive words of the normalised benchmark texts become the
patterns of one automaton, and every document is scanned once.  Matches are
found in the normalised text; word numbers carry them to offsets in the
original.  The automaton is broadcast, so patterns are dealt to automata of a
bounded size and the documents are scanned once for each; at the bound below a
benchmark has a single automaton.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm._base import ALNUM, alnum_words, in_arrow, slices, texts

WINDOW = 10
#: Bytes of patterns that one automaton may hold.
PATTERN_BYTES = 8 << 20
#: A word before lower-casing.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", SPAN),
])


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Windows of size consecutive words, joined by spaces; a shorter text is one window."""
    words = alnum_words(text)
    return [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def patterns(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW, bound: int = PATTERN_BYTES) -> Iterator[dict[bytes, list[str]]]:
    """Windows with the ids of their items, in parts of at most bound bytes.

    The windows are made and grouped by the executors and reach the driver one
    partition at a time, so it never holds more than two parts.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for w in windows(t, size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "pattern"])

    source = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text")).where("item is not null and text is not null")
    part: dict[bytes, list[str]] = {}
    held = 0
    for row in in_arrow(source, cut, "item string, pattern binary").groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items")).toLocalIterator():
        need = len(row.pattern) + sum(map(len, row["items"]))
        if part and held + need > bound:
            yield part
            part, held = {}, 0
        part[bytes(row.pattern)] = list(row["items"])
        held += need
    if part:
        yield part


class Scanner:
    """An automaton over " w1 ... wn " strings of one part."""

    def __init__(self, part: dict[bytes, list[str]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, items in part.items():  # bytes as Latin-1: one character each
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", (len(pattern), items))
        self.automaton.make_automaton()

    def scan(self, normal: bytes) -> list[tuple[int, int, list[str]]]:
        """(start, end, items) in the normalised text " w1 ... wn ", without the outer spaces."""
        return [(end - n, end, items) for end, (n, items) in self.automaton.iter(normal.decode("latin-1"))]


def hit_words(normal: bytes, found: list[tuple[int, int, list[str]]]) -> np.ndarray:
    """Numbers of the words that lie in any match."""
    spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 32)
    edges = np.zeros(len(spaces) + 1, np.int64)
    for start, end, _ in found:
        edges[np.searchsorted(spaces, start) - 1] += 1
        edges[np.searchsorted(spaces, end)] -= 1
    return np.flatnonzero(np.cumsum(edges) > 0)


def spans(text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
    """Offsets in characters of the original, one pair for each run of words."""
    places = [m.span() for m in WORD.finditer(text)]
    runs = np.split(words, np.flatnonzero(np.diff(words) != 1) + 1)
    at = [(places[r[0]][0], places[r[-1]][1]) for r in runs if len(r)]
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in at]


class Automata:
    """All parts of a benchmark; one automaton is held beside the first."""

    def __init__(self, parts: list) -> None:
        self.parts = parts
        self.first = Scanner(parts[0].value) if parts else None

    def scan(self, own: list[bytes]) -> tuple[list[bytes], dict[int, list[tuple[int, int, list[str]]]]]:
        """Normalised texts, and the matches of those that have any."""
        normals = [b" " + b" ".join(t.translate(ALNUM).split()) + b" " for t in own]
        found: dict[int, list] = defaultdict(list)
        for k in range(len(self.parts)):
            scanner = self.first if k == 0 else Scanner(self.parts[k].value)
            for row, normal in enumerate(normals):
                if got := scanner.scan(normal):
                    found[row] += got
        return normals, found


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, size: int = WINDOW, bound: int = PATTERN_BYTES) -> DataFrame:
    """The kept columns (all by default) with n_words, n_hit, items (ids as sorted strings) and hits.

    hits are [start, end) offsets in characters of the original text.  A null
    text has no words, a benchmark row without id or text has no windows, and
    equal windows of several items count for each of them.  Repeated rows are
    scanned each for itself.  An empty benchmark hits nothing.
    """
    keep = docs.columns if keep is None else keep
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(part) for part in patterns(benchmark, size=size, bound=bound)]
    new = {f.name for f in FIELDS}
    kept = [c for c in keep if c.lower() not in new]
    columns = list(dict.fromkeys([*kept, text_col]))
    source = docs.select(*[f"`{c}`" for c in columns])
    schema = T.StructType([source.schema[c] for c in kept] + list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(parts)
        for batch in (part for whole in batches for part in slices(whole, columns.index(text_col))):
            own = texts(batch.column(columns.index(text_col)))
            normals, found = automata.scan(own)
            n_words = [n.count(b" ") - 1 if len(n) > 2 else 0 for n in normals]
            n_hit, items, hits = [0] * len(own), [[] for _ in own], [[] for _ in own]
            for row, got in found.items():
                words = hit_words(normals[row], got)
                n_hit[row], items[row] = len(words), sorted({i for g in got for i in g[2]})
                hits[row] = [{"start": a, "end": b} for a, b in spans(own[row], words)]
            arrays = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(columns.index(c)) for c in kept] + arrays, names=schema.names)

    return in_arrow(source, run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", size: int = WINDOW, bound: int = PATTERN_BYTES) -> DataFrame:
    """The documents without any hit, with all their columns."""
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(part) for part in patterns(benchmark, size=size, bound=bound)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(parts)
        for batch in (part for whole in batches for part in slices(whole, at)):
            _, found = automata.scan(texts(batch.column(at)))
            yield batch.filter(pa.array([k not in found for k in range(batch.num_rows)], pa.bool_()))

    return in_arrow(docs, run, docs.schema)
