"""Toxicity by maximum-scoring segments: token log-odds, every significant passage, extreme-value calibration.

Each word has the log-odds of the toxic label among the labelled texts that hold it, less a drift. Its prior is a Dirichlet
one of `PRIOR` texts, centred on what the word's first bytes say (`PREFIXES`), and that in turn on the share of all
labelled texts: a word never seen inherits what is known of its stem. A linear scan finds the maximal segments of the
word scores (Ruzzo and Tompa 1999). The best segment of n words without a passage follows an extreme-value law (Karlin and
Altschul 1990), exp(-K n exp(-lambda S)); K and lambda are fitted by maximum likelihood to the texts labelled clean, so
that z = lambda S - ln(K n) compares texts of any length. A text's statistic is the z of its best segment and of every
other significant one (z of `SIGNIFICANT` or more), summed; a logistic curve through the labelled texts makes it a score.

A labelled text's own part in the counts is left out wherever the law and the curve are fitted. Counts are made over all
labelled rows and kept as a table of entries; lookup.py says how texts are scored with it when it gets too large to be
sent to every task. Letters A-Z and Latin-1 capitals are lowered; words are runs of other characters than ASCII signs and
`SIGNS`.

Results: a null or empty text, or one without words, has score 0, no passages and statistic null; several labels of one
doc_id count as toxic if one of them does; labels without a doc_id or a value are not learned from; repeated rows and null
ids each give a row (never learned from without an id); extra columns are not read; without toxic or without clean rows
to learn from every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import combine, distinct, drop_written, joined, mix, per_document, released, slices, texts_of, words_of, written
from .lookup import BROADCAST_ENTRIES, Asked, Entries, Model, Tally

PREFIXES, WORD = (4, 6), 2  # bytes of the prefixes, kinds 0 and 1; a word is kind 2
PRIOR, DRIFT, SIGNIFICANT = 8.0, 0.5, 3.0
CLEAN, TOXIC, UNKNOWN = 0, 1, -1
BROADCAST_LABELS = 4_000_000
#: Values of lambda that are tried, and the width of the bins through which the curve is fitted.
RATES = [0.02 * 1.07**i for i in range(110)]
BIN = 0.25

# Signs outside ASCII that part words (fixed values).
SIGNS = "«»“”„‘’…–—¿¡、。，！？"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_GAPS = [(s.encode(), b" " * len(s.encode())) for s in SIGNS]
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)


def plain(data: bytes) -> bytes:
    """The bytes with letters lowered and signs blanked, each at its place."""
    data = data.translate(_LOWER)
    for sign, gap in _GAPS:
        data = data.replace(sign, gap)
    codes = np.frombuffer(data, np.uint8)
    capital = np.flatnonzero((codes[:-1] == 0xC3) & (codes[1:] >= 0x80) & (codes[1:] <= 0x9E) & (codes[1:] != 0x97)) + 1
    if len(capital):
        codes = codes.copy()
        codes[capital] += 0x20
        data = codes.tobytes()
    return data


@dataclass
class Words:
    """The words of a batch of texts: byte bounds in the joined texts, keys by kind, and where each text's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    keys: list[np.ndarray]
    at: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Words:
        data, offsets = joined(texts)
        data = plain(data)
        starts, ends, hashes = words_of(data)
        codes, sizes = np.frombuffer(data + bytes(8), np.uint8), ends - starts
        head = np.zeros(len(starts), np.uint64)
        for i in range(max(PREFIXES)):
            head |= codes[starts + i].astype(np.uint64) << np.uint64(8 * i)
        keys = [mix(head & _MASKS[np.minimum(sizes, n)]) for n in PREFIXES]
        return cls(starts, ends, [*keys, hashes], per_document(starts, offsets), offsets)

    def longer(self, kind: int) -> np.ndarray:
        """Which words have a key of the kind: a prefix is shorter than its word."""
        return np.ones(len(self.starts), bool) if kind == WORD else self.ends - self.starts > PREFIXES[kind]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first, end) of all maximal scoring segments; without a positive score the single best element.

    Runs of positive scores are the units of the scan; each candidate knows the nearest one to its left that begins at a
    lower running total, so that the whole search is linear."""
    if not len(scores):
        return []
    up = np.concatenate([[False], scores > 0, [False]])
    first, end = np.flatnonzero(up[1:] & ~up[:-1]), np.flatnonzero(~up[1:] & up[:-1])
    if not len(first):
        best = int(np.argmax(scores))
        return [(float(scores[best]), best, best + 1)]
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[float, float, int, int, int]] = []  # totals left and right, first, end, nearest lower
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        left, right = float(total[a]), float(total[b])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= left:
                j = held[j][4]
            if j < 0 or held[j][1] >= right:
                held.append((left, right, a, b, j))
                break
            left, a = held[j][0], held[j][2]
            del held[j:]
    return [(right - left, a, b) for left, right, a, b, _ in held]


def shares(n0: np.ndarray, n1: np.ndarray, prior: np.ndarray | float) -> np.ndarray:
    """The expected share of toxic texts under a Dirichlet prior of `PRIOR` texts."""
    return (n1 + PRIOR * prior) / (n0 + n1 + PRIOR)


def times(words: Words) -> np.ndarray:
    """How often each word has stood in its text so far, itself included."""
    text = np.repeat(np.arange(len(words.at) - 1, dtype=np.uint64), np.diff(words.at))
    keys = combine(words.keys[WORD], text)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.concatenate([first, [len(keys)]]))) + 1
    return out


def word_scores(words: Words, entries: Entries, base: float, own: np.ndarray | None = None) -> np.ndarray:
    """Log-odds less the drift of each word; `own` is each text's label, whose part in the counts is left out.

    Counts are of texts, so a text that repeats a word brings little more evidence: its k-th time is worth a k-th."""
    mine = None if own is None else np.repeat(own, np.diff(words.at))
    share: np.ndarray | float = base
    for kind in range(WORD + 1):
        counts = np.zeros((2, len(words.starts)))
        rows, cols, values = entries.find(kind, words.keys[kind])
        counts[cols, rows] = values
        if mine is not None:
            for label in (CLEAN, TOXIC):
                counts[label] = np.maximum(counts[label] - (mine == label), 0)
        share = np.where(words.longer(kind), shares(counts[CLEAN], counts[TOXIC], share), share)
    if not len(words.starts):
        return np.zeros(0)
    odds = np.log(share / (1 - share)) - math.log(base / (1 - base))
    return np.where(odds > 0, odds / times(words), odds) - DRIFT


@dataclass
class Law:
    """Without passages the best segment S of n words has P(S < s) = exp(-k n exp(-rate s)); the curve is logistic."""

    base: float
    rate: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    shift: float = 0.0
    fitted: bool = False

    def statistic(self, n: int, found: list[tuple[float, int, int]]) -> tuple[float | None, list[tuple[float, int, int]]]:
        """The statistic of a text, and its significant segments with their z."""
        if not found:
            return None, []
        level = math.log(self.k * n)
        z = sorted(((self.rate * s - level, a, b) for s, a, b in found), reverse=True)
        kept = [x for x in z if x[0] >= SIGNIFICANT]
        return z[0][0] + sum(x[0] for x in kept[1:]), kept

    def score(self, statistic: float | None) -> float:
        if statistic is None or not self.fitted:
            return 0.0
        return 1 / (1 + math.exp(-min(max(self.slope * statistic + self.shift, -700.0), 700.0)))


def asked(part: pa.RecordBatch) -> Asked:
    words = Words.of(texts_of(part))
    return {kind: distinct(words.keys[kind][words.longer(kind)]) for kind in range(WORD + 1)} if len(words.starts) else {}


def toxic_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row for each labelled document."""
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def text_counts(train: DataFrame) -> DataFrame:
    """kind, gram, col, value: in how many texts of each label a key occurs."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1_000_000)
        for part in slices(batches):
            words, found = Words.of(texts_of(part)), {}
            for i, label in enumerate(part.column("toxic").to_pylist()):
                cut = slice(words.at[i], words.at[i + 1])
                for kind in range(WORD + 1):
                    found.setdefault(f"{kind} {label}", []).append(distinct(words.keys[kind][cut][words.longer(kind)[cut]]))
            for group, keys in found.items():
                tally.add(group, np.concatenate(keys))
            if tally.full():
                yield from tally.rows(("part", "gram", "n"))
        yield from tally.rows(("part", "gram", "n"))

    counted = train.select("text", "toxic").mapInArrow(run, "part string, gram long, n long").groupBy("part", "gram").agg(F.sum("n").cast("double").alias("value"))
    kind, col = F.substring_index("part", " ", 1).cast("int"), F.substring_index("part", " ", -1).cast("int")
    return counted.select(kind.alias("kind"), "gram", col.alias("col"), "value")


def curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (statistic, clean, toxic), by Newton steps on smoothed targets."""
    x, n0, n1 = (np.array(c, float) for c in zip(*bins, strict=True))
    high, low = (n1.sum() + 1) / (n1.sum() + 2), 1 / (n0.sum() + 2)
    n, y = n0 + n1, n1 * high + n0 * low
    scale = max(float(np.abs(x).max()), 1.0)
    x = x / scale
    loss = lambda w: float((n * np.logaddexp(0, w[0] * x + w[1]) - y * (w[0] * x + w[1])).sum() + 1e-6 * (w @ w))
    w = np.array([0.0, math.log(y.sum() / (n.sum() - y.sum()))])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -700, 700)))
        gradient = np.array([((n * p - y) * x).sum(), (n * p - y).sum()]) + 2e-6 * w
        q = n * p * (1 - p)
        hessian = np.array([[(q * x * x).sum(), (q * x).sum()], [(q * x).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]) / scale, 0.0), float(w[1])


def fitted(rows: DataFrame, law: Law) -> Law:
    """The law and the curve by the written table `rows`: toxic, n, best and rest (scores of segments) of labelled texts.

    Two aggregates go to the driver: a sum for each of `RATES`, and a count for each label and bin of the statistic."""
    clean = rows.filter((F.col("toxic") == CLEAN) & (F.col("n") > 0))
    sums = clean.agg(F.count("*"), F.sum("best"), *(F.sum(F.col("n") * F.exp(-F.lit(r) * F.col("best"))) for r in RATES)).first()
    m, total, spread = sums[0], sums[1], sums[2:]
    n_toxic = rows.filter((F.col("toxic") == TOXIC) & (F.col("n") > 0)).count()
    if not m or not n_toxic:
        return law
    likely = [(m * (math.log(m / s) + math.log(r)) - r * total, r, m / s) for r, s in zip(RATES, spread, strict=True) if 0 < s < math.inf]
    _, law.rate, law.k = max(likely)
    level = F.log(F.lit(law.k) * F.col("n"))
    z = F.transform("rest", lambda s: F.lit(law.rate) * s - level)
    statistic = F.lit(law.rate) * F.col("best") - level + F.aggregate(F.filter(z, lambda x: x >= SIGNIFICANT), F.lit(0.0), lambda a, x: a + x)
    counts = rows.filter("n > 0").groupBy(F.floor(statistic / BIN).alias("bin")).agg(F.count_if(F.col("toxic") == CLEAN), F.count_if(F.col("toxic") == TOXIC)).collect()
    law.slope, law.shift = curve(sorted(((r[0] + 0.5) * BIN, r[1], r[2]) for r in counts))
    law.fitted = True
    return law


def learned(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_ENTRIES) -> tuple[Law, Model]:
    """The law and the counts from the labelled ones among `docs` (doc_id, text)."""
    marks = written(toxic_labels(labels))
    train = docs.select("doc_id", "text").join(F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks, "doc_id")
    n0, n1 = train.agg(F.count_if(F.col("toxic") == CLEAN), F.count_if(F.col("toxic") == TOXIC)).first()
    law = Law(base=(n1 + 1) / (n0 + n1 + 2))
    model = Model(written(text_counts(train)), bound)

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        words, own = Words.of(texts_of(part)), part.column("toxic").to_numpy()
        scores, out = word_scores(words, entries, law.base, own), []
        for i, label in enumerate(own.tolist()):
            found = sorted((s for s, _, _ in segments(scores[words.at[i] : words.at[i + 1]])), reverse=True)
            out.append((label, int(words.at[i + 1] - words.at[i]), found[0] if found else None, found[1:]))
        toxic, n, best, rest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(rest, pa.list_(pa.float64()))], ["toxic", "n", "best", "rest"])

    rows = written(model.score(train, asked, answer, "toxic int, n long, best double, rest array<double>"))
    law = fitted(rows, law)
    drop_written(rows, marks)
    return law, model


def passages(docs: DataFrame, law: Law, model: Model) -> DataFrame:
    """doc_id, score, statistic and passages of each row: z, byte bounds and text of every significant segment."""
    schema = "doc_id long, score double, statistic double, passages array<struct<z: double, first: long, end: long, passage: string>>"
    kind = pa.list_(pa.struct([("z", pa.float64()), ("first", pa.int64()), ("end", pa.int64()), ("passage", pa.string())]))

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        texts = texts_of(part)
        words = Words.of(texts)
        scores, out = word_scores(words, entries, law.base), []
        for i, text in enumerate(texts):
            low, high, shift = words.at[i], words.at[i + 1], words.offsets[i]
            statistic, kept = law.statistic(int(high - low), segments(scores[low:high]))
            spans = [(z, int(words.starts[low + a] - shift), int(words.ends[low + b - 1] - shift)) for z, a, b in sorted(kept, key=lambda x: x[1])] if law.fitted else []
            out.append((law.score(statistic), statistic if law.fitted else None, [{"z": z, "first": a, "end": b, "passage": text[a:b].decode()} for z, a, b in spans]))
        score, statistic, spans = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array(statistic, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "statistic", "passages"])

    return model.score(docs.select("doc_id", "text"), asked, answer, schema)


def held_out() -> Column:
    """The rows that are never learned from: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages and statistic of each row of `docs` (doc_id, text); labels: doc_id, toxic."""
    law, model = learned(docs.filter(~held_out()), labels, bound)
    out = passages(docs, law, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "statistic")
