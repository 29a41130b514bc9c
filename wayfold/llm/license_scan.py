"""Licence scan with a positional rare-token index.

Templates (licence texts or single phrases) are indexed by word and position.
A file is scanned for the templates' rare words: for each template its words of
highest inverse document frequency over all documents.  Every place of a rare
word proposes the place where its template would begin; proposals that agree
are intersected, and a template counts only where its mandatory phrases stand
at or near their relative positions.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm._base import ALNUM, alnum_words, in_arrow, mapped, texts

#: Phrases whose label holds wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of common licence notices, with the phrases that must be present.
NOTICES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ("gnu general public license", "free software foundation"),
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee",),
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license v 2 0",),
    ),
    "gpl-line": ("Released under the GNU General Public License", ("gnu general public license",)),
    "apache-line": ("Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    "mit-line": ("Released under the MIT License", ("mit license",)),
    "cc-by-4.0": ("Licensed under CC BY 4.0", ("cc by 4 0",)),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
}

#: Rare words taken from a notice, share of them that must agree, and words by which places may shift.
RARE_WORDS, AGREEING, SHIFT = 4, 0.5, 4


@dataclass
class Template:
    """key_phrases: (words, position in the template); exact: the whole template must stand word for word."""

    label: str
    words: list[bytes]
    key_phrases: list[tuple[list[bytes], int]]
    exact: bool


def find_phrase(words: list[bytes], phrase: list[bytes], low: int, high: int) -> int:
    """First place from low to high at which phrase stands in words, else -1."""
    for k in range(max(0, low), min(high, len(words) - len(phrase)) + 1):
        if words[k] == phrase[0] and words[k : k + len(phrase)] == phrase:
            return k
    return -1


def templates(phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, tuple[str, ...]]] = NOTICES) -> list[Template]:
    out = [Template(label, words := alnum_words(p.encode()), [(words, 0)], True) for p, label in phrases.items()]
    for label, (text, keys) in notices.items():
        words = alnum_words(text.encode())
        own = [alnum_words(k.encode()) for k in keys]
        out.append(Template(label, words, [(k, find_phrase(words, k, 0, len(words))) for k in own], False))
    return out


def document_frequency(docs: DataFrame, of: list[Template], *, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and for each template word those that have it.  As many rows as template words reach the driver."""
    vocabulary = frozenset(w for t in of for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(vocabulary.intersection(text.translate(ALNUM).split()))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    rows = in_arrow(docs.select(F.col(f"`{text_col}`").alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.word): r.n for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of the templates' rarest words: word -> (template, position)."""

    def __init__(self, of: list[Template], n_docs: int, frequency: dict[bytes, int]) -> None:
        self.templates = of
        self.idf = {w: float(np.log((1 + n_docs) / (1 + frequency.get(w, 0)))) for t in of for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.rare = []
        for k, t in enumerate(of):
            order = sorted(range(len(t.words)), key=lambda p, t=t: (-self.idf[t.words[p]], p))
            rare = order[: 1 if t.exact else RARE_WORDS]
            self.rare.append(len(rare))
            for p in rare:
                self.postings[t.words[p]].append((k, p))
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, first word, score 0 to 1) of every place, in order."""
        if self.anchors.isdisjoint(words):
            return []
        votes: dict[int, Counter] = defaultdict(Counter)
        for at, word in enumerate(words):
            for k, p in self.postings.get(word, ()):
                votes[k][at - p] += 1
        found = []
        for k, starts in votes.items():
            t = self.templates[k]
            if t.exact:
                found += [(k, s, 1.0) for s in starts if s >= 0 and words[s : s + len(t.words)] == t.words]
                continue
            taken = -1
            for s in sorted(starts):
                agree = sum(starts.get(s + d, 0) for d in range(SHIFT + 1))
                if s <= taken or agree < AGREEING * self.rare[k]:
                    continue
                places = [find_phrase(words, phrase, s + p - SHIFT, s + p + SHIFT) for phrase, p in t.key_phrases]
                if min(places) < 0:
                    continue
                window = Counter(words[max(0, s) : s + len(t.words) + SHIFT])
                weight = sum(self.idf[w] + 1e-9 for w in t.words)
                held = sum(self.idf[w] + 1e-9 for w in (Counter(t.words) & window).elements())
                found.append((k, max(0, s), held / weight))
                taken = s + len(t.words) - 1
        return sorted(found)


PLACE = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())]))),
    T.StructField("notices", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType())]))),
])


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, of: list[Template] | None = None) -> DataFrame:
    """The kept columns (all by default) with n_words, base and notices.

    base has every place of a phrase, notices every place of a licence notice:
    label, first word (from 0), words of the template and a score: the share of
    the template's IDF weight that the place holds (1 for phrases).  Null and
    empty texts have no words and no places.  Equal places of several templates
    are all given, ordered by template and place.  Word frequencies come from
    all rows, repeated ones counted each time; they decide which words of a
    template are looked up, never whether a phrase counts.
    """
    of = templates() if of is None else of
    keep = docs.columns if keep is None else keep
    n_docs, frequency = document_frequency(docs, of, text_col=text_col)
    index = Index(of, n_docs, frequency)

    def fields(batch: pa.RecordBatch) -> list[pa.Array]:
        n, base, notices = [], [], []
        for text in texts(batch.column(text_col)):
            words = text.translate(ALNUM).split()
            n.append(len(words))
            both = ([], [])
            for k, s, score in index.scan(words):
                t = of[k]
                both[not t.exact].append({"label": t.label, "first_word": s, "n_words": len(t.words), "score": score})
            base.append(both[0])
            notices.append(both[1])
        return [pa.array(n, pa.int64()), pa.array(base, pa.list_(PLACE)), pa.array(notices, pa.list_(PLACE))]

    return mapped(docs, keep, [text_col], FIELDS, fields)
