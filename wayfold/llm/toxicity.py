"""Toxicity by maximum-scoring segments.

Words get log-odds of standing in toxic rather than other documents, shrunk by
an informative Dirichlet prior; a linear-time scan finds every maximal segment
of positive score (Ruzzo and Tompa); Karlin-Altschul statistics turn a segment's
score into the number of such segments that chance would give in a text of that
length; a logistic curve over the extreme values calibrates the document score.

A word's step is the log-odds of its clearest toxic feature, which is the word
itself or its beginning of four or five letters where several words share that;
without one it is the word's own log-odds, negative or weakly positive, under a
prior of NEUTRAL documents that keeps rare words near 0.  A word is counted once
in a document, so a word repeated in one text can't look like evidence from many.

All words keep their log-odds, quantised: a score table of two rows of slots,
MOST_SLOTS each at most, holds them by hash.  Where features share a slot the
commonest one's score is there; a word is looked up in both rows and takes that
of the less common, so it gets another's score only if commoner ones lie on it twice.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm._base import ALNUM, caches, dropped, filtered, in_arrow, mapped, slices, texts, written

#: Slots of a row of the score table at most: 32 MB for the three models, which share commonness, on the driver, 16 MB for one in a worker.
MOST_SLOTS = 1 << 22
#: Prior weight as a share of all counts, least z-score and log-odds of a clear toxic feature.
PRIOR_SHARE, LEAST_Z, LEAST_ODDS = 0.05, 3.0, 2.0
#: Documents, toxic and clean as usual, that a word without clear features has besides its own; what each such word costs; the bounds of its log-odds.
NEUTRAL, DRIFT, WEAKEST, STRONGEST = 30.0, 0.15, -2.0, 1.4
#: Share of the normal bound for the largest of many chance z-scores that a clear feature must reach.
CHANCE_SHARE = 0.85
#: A beginning stands for itself only if no single word has more than this share of its toxic documents.
WORD_SHARE = 0.5
#: Steps of the score table in a unit of log-odds; 0 in the table says that a slot is empty.
GRAIN, ZERO = 16, 128
#: Expected chance segments in a text below which a passage counts as found.
SIGNIFICANT = 0.05
#: Labelled rows at most that fit the calibration curve, those of the smallest hashes.
CALIBRATION_ROWS = 20_000
#: Label rows up to which they are broadcast to the documents (under 64 MB); beyond, both sides are shuffled.
BROADCAST_LABELS = 2_000_000
#: Words whose scores a worker keeps before it starts anew.
CACHE_WORDS = 200_000

#: A word before lower-casing.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def features(word: bytes) -> list[int]:
    """Signed 64-bit hashes of a word and of its beginnings of four and five letters, 0 where it is shorter."""
    text = word.decode("utf-8", "replace")
    parts = [b"w" + word, *(b"p" + text[:n].encode("utf-8", "replace") if len(text) >= n else b"" for n in (4, 5))]
    return [xxhash.xxh3_64_intdigest(p) - (1 << 63) if p else 0 for p in parts]


class Features(dict):
    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = features(word)
        return out


#: Documents with a word by fold and class: clean and toxic of fold 0, of fold 1.
GROUPS = ["y00", "y01", "y10", "y11"]


def class_counts(labelled: DataFrame) -> DataFrame:
    """(word, p4, p5, y00, y01, y10, y11) from (text, fold, toxic): hashes of each word and its beginnings, and its documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in (part for whole in batches for part in slices(whole, 0)):
            seen: list[Counter] = [Counter(), Counter(), Counter(), Counter()]
            for text, fold, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[2 * fold + toxic].update(set(text.translate(ALNUM).split()))
            words = list(set().union(*seen))
            own = np.array([known[w] for w in words], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(own[:, k]) for k in range(3)), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "p4", "p5", *GROUPS])

    rows = in_arrow(labelled.select("text", "fold", "toxic"), count, "word long, p4 long, p5 long, " + ", ".join(f"{g} long" for g in GROUPS))
    return rows.groupBy("word").agg(F.first("p4").alias("p4"), F.first("p5").alias("p5"), *[F.sum(g).alias(g) for g in GROUPS])


#: The folds that a model learns from: both, for rows of fold 0, for rows of fold 1.
MODELS = ((0, 1), (1,), (0,))


def of_folds(folds: tuple[int, ...]) -> tuple[Column, Column]:
    """Clean and toxic documents of these folds."""
    y0, y1 = (sum((F.col(f"y{f}{c}") for f in folds[1:]), F.col(f"y{folds[0]}{c}")) for c in (0, 1))
    return y0, y1


def log_odds(y0: Column, y1: Column, all0: float, all1: float) -> tuple[Column, Column]:
    """Log-odds ratio with a Dirichlet prior and its z-score, from the classes' counts and their sums over all words."""
    prior, total = PRIOR_SHARE * (y0 + y1) + 1e-3, PRIOR_SHARE * (all0 + all1)
    a1, a0 = y1 + prior, y0 + prior
    delta = F.log(a1 / (F.lit(all1 + total) - a1)) - F.log(a0 / (F.lit(all0 + total) - a0))
    return delta, delta / F.sqrt(1 / a1 + 1 / a0)


def neutral_odds(y0: Column, y1: Column, share: float) -> Column:
    """Log-odds of a word to which NEUTRAL documents are added, toxic in the share that all have."""
    return F.log((y1 + NEUTRAL * share) / share) - F.log((y0 + NEUTRAL * (1 - share)) / (1 - share))


def least_z(tested: int) -> float:
    """What z-score counts among so many features: chance alone reaches about sqrt(2 log n), less here as its tail is shorter."""
    return max(LEAST_Z, CHANCE_SHARE * math.sqrt(2 * math.log(max(2, tested))))


@dataclass
class Model:
    """table: two rows of (score, commonness) bytes by slot; lam, k: Karlin-Altschul; curve: of the document score."""

    scores: tuple[bytearray, bytearray]
    common: tuple[bytearray, bytearray]
    lam: float
    k: float
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def looked_up(self, feature: int) -> int:
        """A feature's quantised score, 0 if the table doesn't have it."""
        slots, h = len(self.scores[0]), feature & 0xFFFFFFFFFFFFFFFF
        a, b = (h & 0xFFFFFFFF) % slots, (h >> 32) % slots
        if not self.scores[0][a] or not self.scores[1][b]:
            return 0
        return self.scores[0][a] if self.common[0][a] <= self.common[1][b] else self.scores[1][b]


#: Quantised scores from here on are those of clear toxic features; words without any stay under it.
CLEAR = ZERO + round(GRAIN * 1.5)


def scored(words: DataFrame, sums: dict[str, float]) -> DataFrame:
    """(feature, docs, m0, m1, m2, whole): quantised scores of words and shared beginnings in the three MODELS, 0 for none."""
    ends = [words.where(F.col(p) != 0).groupBy(F.col(p).alias("feature")).agg(*[F.sum(g).alias(g) for g in GROUPS], F.max(F.col("y01") + F.col("y11")).alias("most")) for p in ("p4", "p5")]
    toxic = F.col("y01") + F.col("y11")
    shared = ends[0].unionByName(ends[1]).where(F.col("most") <= WORD_SHARE * toxic).drop("most")
    both = words.select(F.col("word").alias("feature"), *GROUPS, F.lit(True).alias("whole")).unionByName(shared.withColumn("whole", F.lit(False)))
    least = least_z(both.where(toxic >= 2).count())
    values = []
    for folds in MODELS:
        y0, y1 = of_folds(folds)
        all0, all1 = (max(1.0, sum(sums[f"y{f}{c}"] for f in folds)) for c in (0, 1))
        delta, z = log_odds(y0, y1, all0, all1)
        clear = (z >= (least if len(folds) == 2 else LEAST_Z)) & (delta >= LEAST_ODDS)
        weak = F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), neutral_odds(y0, y1, all1 / (all0 + all1))))
        q = F.greatest(F.lit(1), F.least(F.lit(255), F.round(F.when(clear, delta).otherwise(weak) * GRAIN).cast("int") + ZERO))
        values.append(F.when(clear | F.col("whole"), q).otherwise(F.lit(0)))
    docs = sum((F.col(g) for g in GROUPS[1:]), F.col(GROUPS[0]))
    # a half's model takes only what the whole one calls clear for clear, else its thresholds would be lower
    whole_clear = values[0] >= CLEAR
    halves = [F.when((v >= CLEAR) & ~whole_clear, F.when(F.col("whole"), F.lit(ZERO + round(GRAIN * STRONGEST))).otherwise(F.lit(0))).otherwise(v) for v in values[1:]]
    out = both.select("feature", docs.alias("docs"), *[v.cast("int").alias(f"m{k}") for k, v in enumerate([values[0], *halves])], "whole", *GROUPS)
    return out.where("m0 + m1 + m2 > 0")


def fit_models(counts: DataFrame) -> list[Model]:
    """The three MODELS without curves from class_counts."""
    sums = {k: float(v or 0) for k, v in counts.agg(*[F.sum(g).alias(g) for g in GROUPS]).first().asDict().items()}
    table = written(scored(counts, sums), "scores")
    n = table.count()
    slots = min(MOST_SLOTS, 1 << max(16, (8 * n).bit_length()))
    h = F.col("feature")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    common, *scores = [(bytearray(slots), bytearray(slots)) for _ in (None, *MODELS)]
    for row, part in enumerate((low, high)):
        best = table.groupBy((part % slots).cast("int").alias("slot")).agg(F.max(F.struct("docs", "feature", "m0", "m1", "m2")).alias("best"))
        # the four bytes of a slot in one number
        parts = [F.least(F.lit(255), F.floor(F.log2(F.col("best.docs") + 1) * 8)).cast("int"), *[F.shiftleft(F.col(f"best.m{k}"), 8 * k + 8) for k in range(3)]]
        got = best.select("slot", functools.reduce(Column.bitwiseOR, parts).alias("bytes")).toArrow()  # MOST_SLOTS rows of eight bytes at most
        at, values = got.column("slot").to_numpy(), got.column("bytes").to_numpy().astype("<i4", copy=False).view(np.uint8).reshape(-1, 4)
        for k, own in enumerate((common, *scores)):
            np.frombuffer(own[row], np.uint8)[at] = values[:, k]
        del got, at, values
    out = []
    for k, folds in enumerate(MODELS):
        y0, _ = of_folds(folds)
        steps = {r.q: float(r.n or 0) for r in table.where("whole").groupBy(F.col(f"m{k}").alias("q")).agg(F.sum(y0 + F.when(F.col(f"m{k}") >= CLEAR, 0.5).otherwise(0.0)).alias("n")).collect()}  # 255 rows at most
        out.append(Model(scores[k], common, *chance(steps)))
    dropped(table)
    return out


def step_of(q: int) -> float:
    """What a word with this quantised score adds to a segment."""
    return (q - ZERO) / GRAIN if q >= CLEAR else (q - ZERO) / GRAIN - DRIFT if q else -DRIFT


def chance(steps: dict[int, float]) -> tuple[float, float]:
    """Lambda and K of segments in clean text, whose words have the quantised scores with these weights."""
    weight, s = np.array(list(steps.values()), float), np.array([step_of(q) for q in steps], float)
    if not len(s) or s.max() <= 0 or not weight.sum():
        return 1.0, 1.0
    p = weight / weight.sum()
    psi = lambda x: (p * np.exp(np.minimum(50, x * s))).sum() - 1
    low, high = 1e-3, 1.0
    while psi(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if psi(mid) < 0 else (low, mid)
    return max(low, 1e-2), max(1e-6, float(p[s > 0].sum()))


class WordScores(dict):
    """Step of a word: its clearest toxic feature's, else its own log-odds less DRIFT."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        own, *ends = features(word)
        q = self.model.looked_up(own)
        clear = max([q, *(self.model.looked_up(f) for f in ends if f)])
        self[word] = best = step_of(clear if clear >= CLEAR else q)
        return best


def segments(steps: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time, after Ruzzo and Tompa."""
    sums = np.concatenate(([0.0], np.cumsum(steps)))
    found: list[list[float]] = []  # start, end, sum before, sum up to the end
    turns = np.flatnonzero(np.diff(np.concatenate(([False], steps > 0, [False])).astype(np.int8)))  # where runs of positive steps begin and end
    starts, ends = turns[::2], turns[1::2]
    for own in map(list, zip(starts.tolist(), ends.tolist(), sums[starts].tolist(), sums[ends].tolist(), strict=True)):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j -= 1
            if j < 0 or found[j][3] >= own[3]:
                found.append(own)
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def measures(text: bytes, scores: WordScores, model: Model) -> tuple[list[tuple[int, int, float, float]], float, float]:
    """Passages (start, end, score, expected by chance), and two extreme values of the text.

    The first is the best segment's score in units of lambda less the log of K
    times the length, the second the log of 1 plus the sum over significant
    passages of such values; both 0 where nothing stands out.
    """
    words = text.translate(ALNUM).split()
    if not words:
        return [], 0.0, 0.0
    steps = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    if steps.max() <= 0:
        return [], 0.0, 0.0
    size = math.log(1 + model.k * len(words))
    found = [(a, b, s, math.exp(min(50.0, size - model.lam * s))) for a, b, s in segments(steps)]
    best = max(model.lam * s for _, _, s, _ in found) - size
    return [f for f in found if f[3] <= SIGNIFICANT], max(0.0, best), math.log1p(sum(max(0.0, model.lam * s - size) for _, _, s, _ in found))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, ...]:
    """Weights of a logistic curve, the constant last, by Newton's method with halved steps."""
    x = np.column_stack([x, np.ones(len(x))])
    held = np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else -3.0
    loss = lambda v: np.logaddexp(0, x @ v).sum() - (y * (x @ v)).sum() + 0.5 * (held * v * v).sum()
    for _ in range(100 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - y) + held * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows for which training holds (all by default).

    Labels of a repeated id are joined by maximum; rows without id or label are
    unlabelled.  Word scores come from all labelled rows.  The curve comes from
    at most CALIBRATION_ROWS of them, each scored by words learned from the
    other half.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    if training is not None:
        own = own.where(training)
    known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
    order = F.crc32(F.concat(F.lit("fold"), F.col("id").cast("string")))
    labelled = own.join(known, "id").select("text", "toxic", (order % 2).cast("int").alias("fold"), order.alias("order"))
    counts = written(class_counts(labelled), "words")
    model, *halves = fit_models(counts)  # halves: for rows of fold 0, of fold 1
    dropped(counts)

    # the rows of the smallest hashes: a threshold from the count, then only numbers go to the driver
    share = min(1.0, CALIBRATION_ROWS / max(1, labelled.count()))
    sample = labelled.where(F.col("order") <= int(share * 0xFFFFFFFF))

    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scores = [WordScores(m) for m in models]
        for batch in batches:
            rows = [measures(t, scores[f], models[f])[1:] for t, f in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(2)], names=["best", "total", "toxic"])

    got = in_arrow(sample.select("text", "fold", "toxic"), value, "best double, total double, toxic int").toArrow()
    shared.destroy()
    best, total, toxic = (got.column(c).to_numpy().astype(float) for c in ("best", "total", "toxic"))
    model.curve = logistic(np.sqrt(np.column_stack([best, total])), toxic)
    return model


PASSAGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
FIELDS = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))),
])


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with score and passages.

    score is the calibrated probability, 0 to 1; null and empty texts, like
    others where nothing stands out, get the curve's least value.  passages are
    the significant ones in order: [start, end) in characters of the text, score,
    and how many so good chance would give in a text of this length.  Repeated
    rows are scored each for itself.
    """
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_SLOTS bounds it

    def fields(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        scores = worker_scores(m)
        score, passages = [], []
        for text in texts(batch.column(text_col)):
            found, best, total = measures(text, scores, m)
            score.append(probability(m, best, total))
            if not found:
                passages.append([])
                continue
            places = [p.span() for p in WORD.finditer(text)]
            passages.append([{"start": len(text[: places[s][0]].decode()), "end": len(text[: places[e - 1][1]].decode()), "score": v, "expected": x} for s, e, v, x in found])
        return [pa.array(score, pa.float64()), pa.array(passages, pa.list_(PASSAGE))]

    return mapped(docs, keep, [text_col], FIELDS, fields, "toxicity")


def probability(model: Model, best: float, total: float) -> float:
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.sqrt(best) + b * math.sqrt(total) + c))))


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The documents with a score under least, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(column: pa.Array) -> list[bool]:
        m = shared.value
        scores = worker_scores(m)
        return [probability(m, *measures(t, scores, m)[1:]) < least for t in texts(column)]

    return filtered(docs, text_col, keep, "toxicity")


_kept: list = []
caches["toxicity"] = _kept.clear


def worker_scores(model: Model) -> WordScores:
    """Keeps the words' scores from batch to batch of one model."""
    if not _kept or _kept[0] is not model:
        _kept[:] = [model, WordScores(model)]
    return _kept[1]
