"""Byte-level BPE by DuckDB queries inside each partition.

A text falls into pieces by the vocabulary's pattern.  A piece that is a token is
that id.  The others become rows (piece, position, token) of their bytes; a
recursive query joins neighbours with the merge table and contracts each piece's
pair of the least rank, the leftmost first, until no pair is left.  Each distinct
piece is contracted once for many texts.  Decoding joins ids with the vocabulary,
orders the tokens and joins each text's bytes.

The merge table holds every pair of tokens whose bytes joined are a token.  Where
each token's own bytes contract to it by lesser ranks, contracting a piece's pair of
the least rank can't open one of a lesser rank, so all its occurrences that don't
overlap are contracted in one step where a piece is long; for other vocabularies (a check on the driver
tells) one at a time.
"""

from __future__ import annotations

import base64
import functools
import itertools

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm._base import DUCK_MEMORY, caches, mapped

#: Pieces that a worker's cache holds before it starts anew, and the most characters of one it keeps.
CACHE_PIECES, CACHE_CHARS = 500_000, 64
#: Bytes of a piece beyond which its pairs of one rank are contracted together.
SHORT_BYTES = 64
#: Rows that one recursive query makes at most (its steps times its rows), and its most steps.
STEP_ROWS, MOST_STEPS = 4_000_000, 64

MERGES = """
create table merges as
select a.id as a, b.id as b, s.id as id
from (select h, id, unnest(range(1, (length(h) // 2)::bigint)) as k from vocab where length(h) > 2) s
join vocab a on a.h = substr(s.h, 1, (2 * k)::bigint) join vocab b on b.h = substr(s.h, (2 * k + 1)::bigint)
"""

#: A step: each piece's neighbours join the merge table; its pair of the least rank, the leftmost of these, becomes one token.
CONTRACT_SHORT = """
with recursive state(piece, tokens, last) as (
  select piece, tokens, false from pieces
  union all
  select s.piece, case when least is null then tokens else tokens[:(least & 65535)] || [(least >> 16)::int] || tokens[(least & 65535) + 3:] end, least is null
  from (select piece, tokens from state where not last) s left join (
    select piece, min((m.id::bigint << 16) | spot) as least
    from (select piece, unnest(tokens) as a, unnest(tokens[2:]) as b, unnest(range(len(tokens))) as spot from state where not last) t join merges m on t.a = m.a and t.b = m.b
    group by piece) l on s.piece = l.piece)
select piece, tokens from state where last order by piece
"""

#: The same with a row for each token and all pairs of the least rank at once (every second one of a chain of overlapping ones): neighbours' rank, each piece's least, the pairs to contract (every second one of a chain of overlapping ones), their right sides gone.
CONTRACT_LONG = """
with recursive state(piece, pos, token, step, last) as (
  select piece, pos, token, 0, false from tokens
  union all
  select piece, pos, case when taken then rank else token end, step + 1, least is null from (
    select *, lag(taken, 1, false) over (partition by piece order by pos) as gone from (
      select *, coalesce(rank = least and {choice}, false) as taken from (
        select *, spot - max(case when rank is distinct from least then spot end) over (partition by piece order by pos) as place, min(case when rank = least then spot end) over (partition by piece) as first from (
          select s.piece, s.pos, s.token, s.step, m.id as rank, min(m.id) over (partition by s.piece) as least, row_number() over (partition by s.piece order by s.pos) as spot
          from (select *, lead(token) over (partition by piece order by pos) as right_token from state where not last and step < {steps}) s
          left join merges m on m.a = s.token and m.b = s.right_token))))
  where not gone)
select piece, pos, token, last from state where last or step = {steps} order by piece, pos
"""


class Vocabulary:
    """A worker's table of one vocabulary."""

    def __init__(self, ranks_path: str) -> None:
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": ""})
        ids = pa.array(list(self.ranks.values()), pa.int32())
        self.rows("create table vocab as select token, hex(token) as h, id from ranks", ranks=pa.table({"token": pa.array(list(self.ranks), pa.binary()), "id": ids}))

    def rows(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, own in tables.items():
            self.con.register(name, own)
        try:
            out = self.con.sql(sql)
            return out if out is None else out.to_arrow_table()
        finally:
            for name in tables:
                self.con.unregister(name)

    def decoded(self, ids: pa.Array) -> list[bytes | None]:
        """The bytes of each row's ids; of null null."""
        given = ids.to_pylist()
        if any(len(x or b"") % 4 for x in given):
            raise ValueError("ids aren't whole little-endian uint32 numbers")
        flat = np.frombuffer(b"".join(x or b"" for x in given), "<u4")
        row = np.repeat(np.arange(len(given), dtype=np.int32), [len(x or b"") // 4 for x in given])
        placed = pa.table({"text": row, "pos": pa.array(np.arange(len(flat))), "id": flat})
        tokens = self.rows("select token from placed join vocab on placed.id = vocab.id order by text, pos", placed=placed).column(0).combine_chunks()
        known = len(tokens)
        if known != len(flat):
            raise ValueError(f"{len(flat) - known} ids aren't in the vocabulary")
        tokens = pa.concat_arrays(tokens.chunks) if isinstance(tokens, pa.ChunkedArray) else tokens
        data, ends = tokens.buffers()[2], tokens.buffers()[1]
        ends = np.frombuffer(ends or bytes(4), np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
        edges = ends[np.cumsum([0, *(len(x or b"") // 4 for x in given)])].tolist()
        return [None if x is None else data[a:b].to_pybytes() if b > a else b"" for x, a, b in zip(given, edges[:-1], edges[1:], strict=True)]


class Coder(Vocabulary):
    """Also the merge table, and the pieces that the worker has seen."""

    def __init__(self, ranks_path: str, pattern: str, at_once: bool) -> None:
        super().__init__(ranks_path)
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{ranks_path} lacks tokens for {len(missing)} bytes")
        self.split, self.at_once, self.known = regex.compile(pattern).findall, at_once, {}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con.execute(MERGES)

    def contracted(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) that each piece's bytes contract to."""
        out: list[bytes] = [b""] * len(pieces)
        for chosen, fn in ((range(1, SHORT_BYTES + 1), self.short), (range(SHORT_BYTES + 1, 1 << 62), self.long)):
            some = [i for i, p in enumerate(pieces) if len(p) in chosen]
            if some:
                for i, ids in zip(some, fn([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def short(self, pieces: list[bytes]) -> list[bytes]:
        tokens = pa.array(self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)])
        offsets = pa.array(np.cumsum([0, *map(len, pieces)]).astype(np.int32))
        ends = self.rows(CONTRACT_SHORT, pieces=pa.table({"piece": np.arange(len(pieces), dtype=np.int32), "tokens": pa.ListArray.from_arrays(offsets, tokens)}))
        found = ends.column("tokens").combine_chunks()
        edges, flat = (4 * found.offsets.to_numpy().astype(np.int64)).tolist(), found.values.to_numpy().astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def long(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        data = b"".join(pieces)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        state = pa.table({"piece": piece, "pos": pos.astype(np.int32), "token": self.byte_ids[np.frombuffer(data, np.uint8)]})
        out: list[bytes] = [b""] * len(pieces)
        choice = "coalesce(place, spot) % 2 = 1" if self.at_once else "spot = first"
        while state.num_rows:
            steps = int(min(MOST_STEPS, max(1, STEP_ROWS // state.num_rows)))
            state = self.rows(CONTRACT_LONG.format(choice=choice, steps=steps), tokens=state)
            last = state.column("last").to_numpy()
            done = state.filter(pa.array(last))
            piece, token = done.column("piece").to_numpy(), done.column("token").to_numpy().astype("<u4")
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    out[piece[a]] = token[a:b].tobytes()
            state = state.filter(pa.array(~last)).select(["piece", "pos", "token"])
        return out

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces: of those that are tokens at once, of others by contraction; short ones are kept."""
        coded = [p.encode() for p in pieces]
        whole = self.rows("select spot, id from own join vocab using (token)", own=pa.table({"spot": pa.array(range(len(coded)), pa.int32()), "token": pa.array(coded, pa.binary())}))
        ids = dict(zip(whole.column(0).to_pylist(), (np.uint32(i).tobytes() for i in whole.column(1).to_pylist()), strict=True))
        rest = [i for i in range(len(coded)) if i not in ids]
        ids |= zip(rest, self.contracted([coded[i] for i in rest]), strict=True)
        new = {p: ids[i] for i, p in enumerate(pieces)}
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known.clear()
        self.known.update((p, x) for p, x in new.items() if len(p) <= CACHE_CHARS)
        return new

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; of null none."""
        own = [self.split(t) if t else [] for t in texts.to_pylist()]
        coded = pa.array(list(itertools.chain.from_iterable(own)), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        if missing := [p for p, x in zip(distinct, found, strict=True) if x is None]:
            new = self.learn(missing)
            found = [new[p] if x is None else x for p, x in zip(distinct, found, strict=True)]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int32, len(found)) // 4
        first, index = np.cumsum(size, dtype=np.int32) - size, coded.indices.to_numpy()
        n = size[index]
        end = np.cumsum(n, dtype=np.int32)
        data = flat[np.repeat(first[index] - (end - n), n) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)].tobytes()
        pieces = np.cumsum([0, *map(len, own)])
        edges = (4 * np.concatenate(([0], end)).astype(np.int64)[pieces]).tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@functools.lru_cache(1)
def coder(ranks_path: str, pattern: str, at_once: bool) -> Coder:
    """A worker keeps the tables, and what it has learned, from task to task."""
    return Coder(ranks_path, pattern, at_once)


@functools.lru_cache(1)
def vocabulary(ranks_path: str) -> Vocabulary:
    return Vocabulary(ranks_path)


def forgotten() -> None:
    coder.cache_clear()
    vocabulary.cache_clear()


caches["byte_bpe"] = forgotten


@functools.lru_cache(8)
def contracts_at_once(ranks_path: str) -> bool:
    """Whether each token's bytes contract to it, by pairs of lesser ranks than its own."""
    ranks = Vocabulary(ranks_path).ranks

    def own(token: bytes, rank: int) -> bool:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 1:
            least, k = min((ranks.get(a + b, rank + 1), k) for k, (a, b) in enumerate(itertools.pairwise(parts)))
            if least > rank:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    return all(own(t, r) for t, r in ranks.items())


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ids (little-endian uint32) and n_tokens to the kept columns (all by default).

    ranks_path is a file of lines with a token in base64 and its rank, on every
    worker; pattern splits texts first and should match each character in some
    piece (what it leaves out isn't encoded).  Special tokens are ordinary text.
    Null and empty texts have no ids.  Repeated rows are encoded each for itself;
    a kept column named ids or n_tokens gives way.  An empty table gives no rows.
    """
    at_once = contracts_at_once(ranks_path)
    fields = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = coder(ranks_path, pattern, at_once).encoded(batch.column(batch.schema.names.index(text_col)))
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return mapped(docs, docs.columns if keep is None else keep, [text_col], fields, run, "byte_bpe")


def decode(rows: DataFrame, ranks_path: str, *, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds decoded, the bytes of ids as encode() writes them; of null null, of no ids none.

    Bytes of a broken character stay as they are; an id outside the vocabulary
    raises an error.  A kept column named decoded gives way.
    """
    fields = T.StructType([T.StructField("decoded", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(vocabulary(ranks_path).decoded(batch.column(batch.schema.names.index(ids_col))), pa.binary())]

    return mapped(rows, rows.columns if keep is None else keep, [ids_col], fields, run, "byte_bpe")
