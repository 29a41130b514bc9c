"""Periodic runs of words by Kolpakov and Kucherov's method.

A suffix automaton gives the Lempel-Ziv factors of a text: each is a new word or
the longest stretch that has begun before.  A run that touches a border between
factors comes from Main's algorithm, which compares what stands to the left and
right of the border in time linear in the two factors around it.  Any other run
lies strictly inside a factor and is copied from the factor's earlier occurrence.

A run of the least exponent asked for holds each of its triples of words several
times, at places one period apart.  So stretches whose triples don't come that
often in their document hold no run and need no factors; on running text that is
nearly all.  The counts are exact but for hashes that meet, which only add
stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm._base import mapped, texts
from wayfold.llm.ngram_join import mixed

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words whose places tell where a run can be.
GRAM = 3

Run = tuple[int, int, int]


def automaton(word: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of the suffix automaton's states (0 is the start), and where each state's stretches end first."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for at, x in enumerate(word):
        new = len(step)
        step.append({})
        length.append(at + 1)
        first.append(at)
        link.append(0)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
        last = new
    return step, first


def factors(word: list[int]) -> list[Run]:
    """(begin, end, earlier begin) of the Lempel-Ziv factors; a new word's earlier begin is its own."""
    step, first = automaton(word)
    out, begin, n = [], 0, len(word)
    while begin < n:
        state, end = 0, begin
        while end < n:
            following = step[state].get(word[end])
            if following is None or first[following] >= end:
                break
            state, end = following, end + 1
        if end == begin:
            out.append((begin, begin + 1, begin))
        else:
            out.append((begin, end, first[state] - (end - begin) + 1))
        begin = out[-1][1]
    return out


def matches(word: list[int], upto: int) -> list[int]:
    """For each place below upto, how long the stretch from there agrees with the beginning of word."""
    n = len(word)
    out = [0] * min(upto, n)
    if out:
        out[0] = n
    left = right = 0
    for k in range(1, len(out)):
        z = min(right - k, out[k - left]) if k < right else 0
        while k + z < n and word[z] == word[k + z]:
            z += 1
        if k + z > right:
            left, right = k, k + z
        out[k] = z
    return out


def touching(word: list[int], border: int, end: int, reach: int, exponent: int) -> list[Run]:
    """Repetitions (start, end, period) that begin at or before a border, end at or after it and by end, and go no further to either side.

    Only those within reach words before the border; each fills two periods at least.
    """
    before, after = word[border - reach : border], word[border:end]
    longest = (reach + len(after)) // exponent
    if longest < 1:
        return []
    back = before[::-1]
    found = []
    for a, q, b in [
        *((reach_left, q, q + right) for q, (reach_left, right) in enumerate(rightwards(before, back, after, min(longest, len(after))), 1)),
        *((q + left, q, reach_right) for q, (left, reach_right) in enumerate(leftwards(before, back, after, min(longest, reach)), 1)),
    ]:
        if a + b < 2 * q:
            continue
        s, t = border - a, border + b
        if (s == 0 or word[s - 1] != word[s - 1 + q]) and (t == len(word) or word[t] != word[t - q]):
            found.append((s, t, q))
    return found


def rightwards(before: list[int], back: list[int], after: list[int], most: int) -> list[tuple[int, int]]:
    """For periods 1 ... most: how far what stands before the border, and what stands from it, agrees with what comes a period later."""
    if most < 1:
        return []
    own, n = matches(after, most + 1), len(after)
    z = matches([*back, -1, *after[most - 1 :: -1], *back], len(back) + 1 + most)
    return [(z[len(back) + 1 + most - q], own[q] if q < n else 0) for q in range(1, most + 1)]


def leftwards(before: list[int], back: list[int], after: list[int], most: int) -> list[tuple[int, int]]:
    """The same with what comes a period earlier."""
    if most < 1:
        return []
    own, n = matches(back, most + 1), len(before)
    near = before[n - most :]
    z = matches([*after, -1, *near, *after], len(after) + 1 + most)
    return [(own[q] if q < n else 0, z[len(after) + 1 + most - q]) for q in range(1, most + 1)]


def periodic_runs(word: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[Run]:
    """All runs (start, end, smallest period) of at least least_length words and least_exponent periods, by start, then period."""
    period: dict[tuple[int, int], int] = {}
    starts: dict[int, dict[int, int]] = {}

    def add(s: int, t: int, q: int) -> None:
        if t - s >= least_length and t - s >= least_exponent * q and period.get((s, t), q) >= q:
            period[s, t] = starts.setdefault(s, {})[t] = q

    earlier = 0
    for begin, end, copied in factors(word):
        reach = min(begin, 2 * earlier + end - begin)
        for s, t, q in touching(word, begin, end, reach, least_exponent):
            add(s, t, q)
        back = begin - copied
        if back and starts:
            for s in range(begin + 1, end):
                if s - back in starts:
                    for t, q in list(starts[s - back].items()):
                        if t + back < end:
                            add(s, t + back, q)
        earlier = end - begin
    for s, t, q in touching(word, len(word), len(word), min(len(word), 2 * earlier), least_exponent):
        add(s, t, q)
    return sorted(((s, t, q) for (s, t), q in period.items()), key=lambda r: (r[0], r[2], r[1]))


def triples_needed(least_length: int, least_exponent: int) -> int:
    """How often a run holds each of its triples, at least."""
    return min((max(least_length, least_exponent * q) - GRAM + 1) // q for q in range(1, least_length + GRAM + 1))


def stretches(code: np.ndarray, doc: np.ndarray, need: int, least_length: int) -> list[tuple[int, int]]:
    """Places from ... to of the flat words of many documents outside which no run can be."""
    n = len(code)
    if need < 2 or least_length < GRAM:
        cuts = np.flatnonzero(np.diff(doc)) + 1
        edges = [0, *cuts.tolist(), n]
        return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a >= least_length]
    if n < least_length:
        return []
    c = code.astype(np.uint64)
    key = mixed(c[2:] + mixed(c[1:-1] + mixed(c[:-2] + mixed(doc[:-2].astype(np.uint64)))))
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    good = (count[place] >= need) & (doc[2:] == doc[:-2])
    # a change of document lies between good places, as the last two of each are none
    edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    return [(a, b + GRAM - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= least_length - GRAM + 1]


def find_runs(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Adds run_words, periodic_runs and collapsed to the kept columns (all by default).

    Words are what white space (bytes 0x20, 0x09 to 0x0D) leaves apart, compared as they
    are.  A run is a stretch of words with the smallest period q that is least_length
    words and least_exponent (2 at least) periods long and can't be extended to
    either side; periodic_runs lists (start, length, period) by start, then period.
    collapsed is the text without words that a run holds after its first period,
    joined by one space.  Null and empty texts have no words and no runs; repeated
    rows give the same; kept columns of these names give way.  Runs of one text are
    found in one task, in time and memory linear in it.  An empty table gives no rows.
    """
    if least_exponent < 2 or least_length < 1:
        raise ValueError("a run has two periods at least")
    need = triples_needed(least_length, least_exponent)
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    fields = T.StructType([T.StructField("run_words", T.LongType()), T.StructField("periodic_runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def found(batch: pa.RecordBatch) -> list[pa.Array]:
        own = [t.split() for t in texts(batch.column(batch.schema.names.index(text_col)))]
        size = np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(size) - size
        code = pa.array([w for ws in own for w in ws], pa.binary()).dictionary_encode().indices.to_numpy()
        doc = np.repeat(np.arange(len(own)), size)
        runs: dict[int, set[Run]] = {}
        for a, b in stretches(code, doc, need, least_length):
            at = int(doc[a])
            moved = a - int(first[at])
            runs.setdefault(at, set()).update((s + moved, t + moved, q) for s, t, q in periodic_runs(code[a:b].tolist(), least_length, least_exponent))
        listed, collapsed = [], []
        for k, words in enumerate(own):
            some = sorted(runs.get(k, ()), key=lambda r: (r[0], r[2], r[1]))
            listed.append([{"start": s, "length": t - s, "period": q} for s, t, q in some])
            if some:
                kept = np.ones(len(words), bool)
                for s, t, q in some:
                    kept[s + q : t] = False
                words = [words[i] for i in np.flatnonzero(kept).tolist()]
            collapsed.append(b" ".join(words).decode())
        return [pa.array(size), pa.array(listed, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(collapsed, pa.string())]

    return mapped(docs, docs.columns if keep is None else keep, [text_col], fields, found)
