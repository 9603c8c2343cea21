"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio of trusted against raw text.

Two multinomials over hashed unigrams and bigrams: the raw one from every document, the trusted one from every document
labelled good. The number of buckets follows the size of the corpus (`BYTES_PER_BUCKET`), so that a bucket mixes as many
n-grams at any size. A text's verdict is the mean of log(trusted / raw) over its n-grams against a threshold learned from
the labelled rows: the lowest score but for `TRIM` of them, less `MARGIN`. A row's own n-grams are always left out of the
raw counts that score it, and of the trusted ones where the threshold is set. Smoothing by `SMOOTHING` expected n-grams keeps buckets with little evidence near 0. The
counts are a table of entries; lookup.py says how texts are scored with it when it gets too large to be sent to every task.

Results: a null or empty text has no words, fails the base rules and has score null; ties with the threshold are kept;
repeated rows and null ids each give a row; extra columns are not read; without labels every ratio is 0 and the base rules
decide alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import combine, drop_written, joined, mix, per_document, released, slices, texts_of, words_of, written
from .lookup import BROADCAST_ENTRIES, Asked, Entries, Model, Tally

BYTES_PER_BUCKET, MIN_BITS, TRIM, MARGIN, SMOOTHING, BROADCAST_LABELS = 8192, 16, 0.002, 0.02, 20.0, 4_000_000
MIN_WORDS, WINDOW, MAX_REPEATED = 10, 5, 20
COUNTS, RAW, GOOD = 0, 0, 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ngram_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of a text's words and of its pairs of neighbours."""
    return np.concatenate([mix(hashes), combine(hashes[:-1], hashes[1:])]) & np.uint64((1 << bits) - 1)


def bucket_bits(docs: DataFrame) -> int:
    """Bits of a bucket's number: the least at which a bucket stands for at most `BYTES_PER_BUCKET` bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(MIN_BITS, (size // BYTES_PER_BUCKET).bit_length())


def base_counts(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of one text; `starts` and `ends` are offsets into `data`."""
    codes = np.frombuffer(data, np.uint8)
    # every byte outside words is one of six white-space characters, so code points are counted over the whole text
    points = len(codes) - int(np.count_nonzero((codes & 0xC0) == 0x80))
    word_chars = points - (len(codes) - int((ends - starts).sum()))
    symbols = int(np.count_nonzero(_SYMBOL[codes]))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    repeated = 0
    if len(hashes) >= WINDOW:
        n = len(hashes) - WINDOW + 1
        keys = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            keys = combine(keys, hashes[i : i + n])
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            cover = np.zeros(len(hashes) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(cover[:-1]) > 0))
    return word_chars, symbols, len(lines) - len(set(lines)), repeated


def _texts(part: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    texts = texts_of(part)
    data, offsets = joined(texts)
    starts, ends, hashes = words_of(data)
    at = per_document(starts, offsets)
    for i, text in enumerate(texts):
        cut = slice(at[i], at[i + 1])
        yield text or b"", starts[cut] - offsets[i], ends[cut] - offsets[i], hashes[cut]


def bucket_counts(docs: DataFrame, good: DataFrame, bits: int) -> DataFrame:
    """bucket, raw and good: counts over all documents and over those whose doc_id is in `good`, in one pass."""
    marked = docs.select("doc_id", "text").join(good.withColumn("good", F.lit(True)), "doc_id", "left")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1_000_000)
        for part in slices(batches):
            found: dict[str, list[np.ndarray]] = {"raw": [], "good": []}
            for mark, (_, _, _, hashes) in zip(part.column("good").to_pylist(), _texts(part), strict=True):
                if len(hashes):
                    found["good" if mark else "raw"].append(ngram_buckets(hashes, bits))
            for group, keys in found.items():
                if keys:
                    tally.add(group, np.concatenate(keys))
            if tally.full():
                yield from tally.rows(("part", "bucket", "n"))
        yield from tally.rows(("part", "bucket", "n"))

    counts = marked.mapInArrow(run, "part string, bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("part") == "good", F.col("n")).otherwise(0)).alias("good"))


def ratios(raw: np.ndarray, good: np.ndarray, share: float) -> np.ndarray:
    """log(trusted / raw) by counts, smoothed towards 0; `share` is the trusted part of all n-grams."""
    return np.log((good + SMOOTHING * share) / ((raw + SMOOTHING) * share)) if share > 0 else np.zeros(len(raw))


def asked(part: pa.RecordBatch, bits: int) -> Asked:
    keys = [ngram_buckets(hashes, bits) for _, _, _, hashes in _texts(part) if len(hashes)]
    return {COUNTS: np.unique(np.concatenate(keys))} if keys else {}


@dataclass
class Judge:
    bits: int
    total: int  # n-grams of all documents, and of the trusted ones
    trusted: int
    threshold: float = 0.0

    def score_of(self, hashes: np.ndarray, entries: Entries, labelled: bool = False) -> float | None:
        """The mean ratio of a text's n-grams, null without words. A text says nothing about itself: its own n-grams are left
        out of the raw counts, and of the trusted ones if it is `labelled` good."""
        if not len(hashes):
            return None
        used, own = np.unique(ngram_buckets(hashes, self.bits), return_counts=True)
        both = np.zeros((len(used), 2))
        rows, cols, values = entries.find(COUNTS, used)
        both[rows, cols] = values
        n = own.sum()
        share = (self.trusted - n * labelled) / max(self.total - n, 1)
        return round(float((ratios(np.maximum(both[:, RAW] - own, 0), both[:, GOOD] - own * labelled, share) * own).sum() / n), 6)


def over(docs: DataFrame, model: Model, bits: int, answer: Callable[[pa.RecordBatch, Entries], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    return model.score(docs, lambda part: asked(part, bits), answer, schema)


def learned(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_ENTRIES) -> tuple[Judge, Model]:
    """What judges, and the raw and trusted counts of each bucket."""
    bits = bucket_bits(docs)
    good = written(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct())
    marks = F.broadcast(good) if good.count() <= BROADCAST_LABELS else good
    counts = written(bucket_counts(docs, marks, bits))
    total, trusted = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    cells = F.array(F.struct(F.lit(RAW).alias("col"), F.col("raw").cast("double").alias("value")), F.struct(F.lit(GOOD).alias("col"), F.col("good").cast("double").alias("value")))
    model = Model(written(counts.select(F.lit(COUNTS).alias("kind"), F.col("bucket").alias("gram"), F.inline(cells))), bound)
    out = Judge(bits, total, trusted)

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        scores = [out.score_of(hashes, entries, True) for _, _, _, hashes in _texts(part) if len(hashes) >= MIN_WORDS]
        return pa.RecordBatch.from_arrays([pa.array(scores, pa.float64())], ["score"])

    own = docs.select("doc_id", "text").join(marks, "doc_id", "left_semi")
    low = over(own, model, bits, answer, "score double").agg(F.percentile("score", F.lit(TRIM)).alias("low")).first().low
    drop_written(good, counts)
    out.threshold = (low if low is not None else 0.0) - MARGIN
    return out, model


def scored(docs: DataFrame, judge: Judge, model: Model) -> DataFrame:
    """The base counts and the score of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("score", pa.float64())])

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        rows = [(len(hashes), *base_counts(text, starts, ends, hashes), judge.score_of(hashes, entries)) for text, starts, ends, hashes in _texts(part)]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return over(docs.select("doc_id", "text"), model, judge.bits, answer, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules and the ratio keep."""
    judge, model = learned(docs, labels)

    def answer(part: pa.RecordBatch, entries: Entries) -> pa.RecordBatch:
        keep = []
        for text, starts, ends, hashes in _texts(part):
            n = len(hashes)
            good = n >= MIN_WORDS and judge.score_of(hashes, entries) >= judge.threshold
            keep.append(good and 100 * base_counts(text, starts, ends, hashes)[3] <= MAX_REPEATED * n)
        return part.filter(pa.array(keep, pa.bool_()))

    return over(docs, model, judge.bits, answer, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, bound: int = BROADCAST_ENTRIES) -> DataFrame:
    """Base counts, score, base_failed and kept of every row of `docs` (doc_id, text); labels: doc_id, quality."""
    found, model = learned(docs, labels, bound)
    out = scored(docs, found, model)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("score", F.lit(0.0)) >= found.threshold))
