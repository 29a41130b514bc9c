"""Packing by power-of-two decomposition.

A document of n ids is cut, from its start, into pieces of the largest length
and then into the powers of two of the rest's binary form, longest first.  Each
piece is a sequence of its own, so no sequence crosses documents and none is
padded; equal lengths share a bucket, from which batches of one shape are drawn.
The step is a single map: nothing is shuffled or gathered.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm._base import caches, in_arrow, shared_path, slices

#: Words that a worker's cache holds in each of its two generations, and the longest it keeps.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Bits of a sequence id: bucket, input partition, count within both.
PARTITION_SHIFT, BUCKET_SHIFT = 34, 58


#: The steps of a tokenizer that sees each word alone: white space made one space, lower case, pieces by a pattern without white space, words' ends marked.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters that normalisation leaves single, and stops that no pattern joins to a letter before them.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*"
#: Marks that may join an ASCII letter before them, as all such ones lie here.
MARKS = "\u0300-\u036f"


def wordwise(setup: dict) -> bool:
    """Whether a tokenizer's file has just these steps, and no added token that a word of letters or stops, or a cut between them, could touch."""
    steps = ((setup.get("normalizer") or {}).get("normalizers") or [], (setup.get("pre_tokenizer") or {}).get("pretokenizers") or [])
    if [x["type"] for x in steps[0]] != NORMALIZERS or [x["type"] for x in steps[1]] != ["Split", "ByteLevel"]:
        return False
    space, split, level = steps[0][1], *steps[1]
    return (
        (space["pattern"], space["content"]) == ({"Regex": "\\s+"}, " ") and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
        and not level["add_prefix_space"] and not level["use_regex"] and setup["model"].get("end_of_word_suffix") == "</w>" and not setup.get("truncation") and not setup.get("padding")
        and all(t["special"] and not t["normalized"] and not re.search(rf"[\s{STOPS}{MARKS}]|^[{LETTERS}]*$", t["content"]) for t in setup.get("added_tokens", []))
    )


class WordIds:
    """Ids of whole texts, each distinct word tokenised once for many texts.

    A tokenizer that is set up as wordwise() says drops white space, and looks at no
    context across it nor between letters and the stops after them; for any other,
    whole texts are tokenised.  So ids of a text are the ids of
    its words joined.  Words of letters or stops alone are one run to the
    tokenizer, whose last id has the vocabulary's end mark: in lower case they are
    tokenised many in a string by the same model without its other steps, which
    don't change them, and cut at those ids.  Any other word goes on its own.

    A-Z is lower-cased before words are told apart, but in texts with marks that
    join letters, or with an added token in any case.
    """

    #: What normalisation, but for case, leaves as one run.
    plain = re.compile(f"(?:[{LETTERS}]+|[{STOPS}]+)").fullmatch

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.wordwise = wordwise(setup)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        added = "".join(f"|(?i:{re.escape(t['content'])})" for t in setup.get("added_tokens", []))
        self.as_they_are = f"[{MARKS}]{added}"
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encoded(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words."""
        one, own, ids = [], [], {}
        for w in words:
            (one if self.plain(w) else own).append(w)
        for at in range(0, len(one), 500):
            part = one[at : at + 500]
            got = np.asarray(self.runs.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[got]) + 1
            if len(cut) != len(part):
                own += part
                continue
            data, edges = got.tobytes(), [0, *(4 * cut).tolist()]
            ids.update((w, data[a:b]) for w, a, b in zip(part, edges[:-1], edges[1:], strict=True))
        ids.update((w, np.asarray(x, "<u4").tobytes()) for w, x in zip(own, self.encoded(own), strict=True))
        return ids

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; of the short ones, those that came up lately are kept."""
        found = list(map(self.known.get, words))
        at = [k for k, x in enumerate(found) if x is None]
        rest = [words[k] for k in at]
        got = list(map(self.before.get, rest))
        new = self.learn([w for w, x in zip(rest, got, strict=True) if x is None])
        if len(self.known) + len(rest) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        for k, w, x in zip(at, rest, got, strict=True):
            found[k] = x = new[w] if x is None else x
            if len(w) <= CACHE_CHARS:
                self.known[w] = x
        return found

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as one array, and where each text begins in it, with the end."""
        texts = pc.fill_null(texts, "")
        if not self.wordwise:
            each = [np.asarray(x, "<u4") for x in self.encoded(texts.to_pylist())]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([0, *map(len, each)])
        lower = pc.if_else(pc.match_substring_regex(texts, self.as_they_are), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, rf"([{LETTERS}])([{STOPS}]+)(\s|$)", r"\1 \2\3"))
        coded = words.flatten().dictionary_encode()
        found = self.looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = pa.array(found, pa.large_binary()).take(coded.indices)
        end = np.frombuffer(flat.buffers()[1] or bytes(8), np.int64)[: len(flat) + 1] // 4
        ids = np.frombuffer(flat.buffers()[2] or b"", "<u4")[: end[-1]]
        return ids, end[words.offsets.to_numpy()]


@functools.lru_cache(1)
def tokenizer_ids(path: str) -> WordIds:
    """A worker keeps what it has learned from task to task."""
    return WordIds(path)


caches["tokenizer"] = tokenizer_ids.cache_clear


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two up to longest, descending."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset.

    longest must be a power of two.  Null and empty texts have end_id alone.
    Repeated rows are packed each for itself and a null id stays null.  bucket is
    the length's power of two; sequence ids are unique and ascend by bucket, input
    partition and row.  They don't change when a task runs again.  An empty table
    gives no rows.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = f"`{id_col}` {source.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
    names = [id_col, "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made = tokenizer_ids(tokenizer_path), [0] * longest.bit_length()
        base = TaskContext.get().partitionId() << PARTITION_SHIFT
        for batch in batches:
            for part in slices(batch, 1):
                own, edges = ids.of(part.column(1))
                stream = np.insert(own, edges[1:], end_id).astype("<u4", copy=False)
                total = np.diff(edges) + 1
                sizes = [piece_lengths(n, longest) for n in total.tolist()]
                row = np.repeat(np.arange(part.num_rows), np.fromiter(map(len, sizes), np.int64, len(sizes)))
                length = np.fromiter(itertools.chain.from_iterable(sizes), np.int64, len(row))
                bounds = np.concatenate(([0], np.cumsum(length)))
                start = bounds[:-1] - (np.cumsum(total) - total)[row]
                bucket = np.log2(length).astype(np.int64)  # exact for powers of two
                sequence = (bucket << BUCKET_SHIFT) + base
                for b in np.unique(bucket).tolist():
                    same = np.flatnonzero(bucket == b)
                    sequence[same] += made[b] + np.arange(len(same))
                    made[b] += len(same)
                data = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), data, pa.array(total[row]), pa.array(bucket.astype(np.int32)), pa.array(sequence), pa.array(np.zeros(len(row), np.int64))], names=names)

    return in_arrow(source, run, schema, "tokenizer")


def write_buckets(pieces: DataFrame, path: str | None = None) -> str:
    """Writes pieces as Parquet, a folder for each bucket; returns the path."""
    path = path or shared_path(pieces.sparkSession, "buckets")
    pieces.write.partitionBy("bucket").parquet(path)
    return path
