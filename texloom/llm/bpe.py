"""Byte-level BPE encoding and decoding.

One narrow stage of three steps, without a shuffle:
1. Arrow: split each text by the public pattern, number the words and send on each distinct word once per part of the
   input, with the ranks of the merges whose bytes occur in it, in order;
2. Spark higher-order functions: fold those ranked merges over the word's bytes, each merge read from a literal rank map;
3. Arrow: put the ids together document by document from the numbered words, and decode by concatenating the tokens' bytes.

A token is one character (its id as a code point; ids stay below the surrogates), so a word's bytes are a string of
characters, and a merge replaces two neighbouring characters by one, from the left. Since a merge's parts have lower ranks
than what it makes, one pass in rank order does all that repeated searches for the lowest pair would do. A word longer than
`FOLD_BYTES` has too many candidates, and is merged by a heap in step 3.

Results: a null text is encoded as empty; any Unicode text round-trips; repeated rows and null ids each give a row;
extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct, prefix_sums, released, slices, window_hashes
from .pretoken import pieces

FOLD_BYTES, DICTIONARY_WORDS, MOST_RANKS = 64, 150_000, 0xD800
#: Bytes of text that one batch numbers: its temporary arrays take some fifty times as much.
SLICE_BYTES = 1 << 17


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if max(found.values()) >= MOST_RANKS:
        raise ValueError(f"a vocabulary of {MOST_RANKS} ranks or more has no single characters for its tokens")
    return found


@lru_cache(maxsize=4)
def merges_of(path: str) -> list[str]:
    """By rank: the two tokens, as characters, that the merge of this rank joins; empty for single bytes."""
    ranks = ranks_of(path)
    out = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = heap_merges(token, ranks, rank)
            if len(parts) != 2:
                raise ValueError(f"the token of rank {rank} is not made of two others of lower ranks")
            out[rank] = chr(parts[0]) + chr(parts[1])
    return out


def fold_merges(word: Column, merges: Column, path: str) -> Column:
    """The tokens of a word (characters of its bytes) after the merges (ranks, ascending) that may apply to it."""
    table = merges_of(path)
    pair = F.from_json(F.lit(json.dumps(table)), "array<string>")  # folded to a literal by the optimiser
    made = F.from_json(F.lit(json.dumps([chr(r) for r in range(len(table))])), "array<string>")
    return F.aggregate(merges, word, lambda tokens, rank: F.replace(tokens, F.get(pair, rank), F.get(made, rank)))


def heap_merges(word: bytes, ranks: dict[bytes, int], below: int = 1 << 31) -> list[int]:
    """The ids by a heap of pairs over linked pieces, with merges of ranks under `below`: for words too long for the fold."""
    end, left, right = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
    alive = [True] * len(word)
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2], below)) < below]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else len(word)
        if not alive[i] or j >= len(word) or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < len(word):
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]], below)) < below:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : stop], below)) < below:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[i : end[i]]] for i in range(len(word)) if alive[i]]


_NUMBERED = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("fresh", pa.bool_()), ("new", pa.list_(pa.string())), ("merges", pa.list_(pa.list_(pa.int32()))), ("long", pa.list_(pa.binary()))])


@lru_cache(maxsize=4)
def token_index(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the tokens of two bytes or more, their ranks, and which hashes' low bits occur at all."""
    tokens = [(t, r) for t, r in ranks_of(path).items() if 1 < len(t) <= FOLD_BYTES]
    data, ends = b"".join(t for t, _ in tokens), np.cumsum([0] + [len(t) for t, _ in tokens])
    hashes = window_hashes(prefix_sums(data), ends[:-1], ends[1:])
    order = np.argsort(hashes)
    low = np.zeros(1 << 20, bool)
    low[hashes & np.uint64((1 << 20) - 1)] = True
    return hashes[order], np.array([r for _, r in tokens], np.int64)[order], low


def candidates(words: list[bytes], path: str) -> pa.ListArray:
    """For each word the ranks, ascending, of the tokens of two bytes or more that occur in it.

    Windows are compared by hash: one too many would do no harm, since the fold only merges what stands side by side."""
    hashes, ranks, low = token_index(path)
    sizes = np.array([len(w) for w in words], np.int64)
    data, ends = b"".join(words), np.cumsum(sizes)
    sums = prefix_sums(data)
    at, room, word = np.arange(len(data)), np.repeat(ends, sizes) - np.arange(len(data)), np.repeat(np.arange(len(words)), sizes)
    found = [np.zeros(0, np.int64)]
    for length in range(2, int(sizes.max(initial=0)) + 1):
        fits = room[at] >= length
        at = at[fits]
        h = window_hashes(sums, at, at + length)
        may = np.flatnonzero(low[h & np.uint64((1 << 20) - 1)])
        place = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
        hit = hashes[place] == h[may]
        found.append(word[at[may[hit]]] << 16 | ranks[place[hit]])
    keys = distinct(np.concatenate(found))
    offsets = np.searchsorted(keys >> 16, np.arange(len(words) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys & 0xFFFF, pa.int32()))


def _number(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Each text as numbers of distinct words, in order of first use, after a row that brings the words new to a slice.

    The numbering starts anew (`fresh`) when more than DICTIONARY_WORDS words are known, which bounds both sides' memory."""
    ranks = ranks_of(path)
    byte = {i: chr(ranks[bytes([i])]) for i in range(256)}
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    for part in slices(batches, limit=SLICE_BYTES):
        split = [pieces(t) if t else [] for t in part.column("text").to_pylist()]
        every = list(chain.from_iterable(split))
        fresh = len(known) > DICTIONARY_WORDS
        if fresh:
            known.clear()
        before = len(known)
        flat = np.fromiter(map(known.__getitem__, every), np.int32, len(every))
        new = [] if len(known) == before else list(islice(reversed(known), len(known) - before))[::-1]
        raw = [w.encode() for w in new]
        long = [b for b in raw if len(b) > FOLD_BYTES]
        raw = [b"" if len(b) > FOLD_BYTES else b for b in raw] if long else raw
        short = [b.decode("latin-1").translate(byte) for b in raw]
        merges = pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), candidates(raw, path))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], f.type) for x, f in zip((None, None, fresh, short), _NUMBERED)), merges, pa.array([long], _NUMBERED.field("long").type)], schema=_NUMBERED)
        offsets = np.cumsum([0] + [len(words) for words in split]).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), words, *(pa.nulls(part.num_rows, _NUMBERED.field(i).type) for i in range(2, 6))], schema=_NUMBERED)


def numbered_words(docs: DataFrame, path: str) -> DataFrame:
    """Step 1."""
    return docs.select("doc_id", "text").mapInArrow(released(lambda batches: _number(batches, path)), "doc_id long, words array<int>, fresh boolean, new array<string>, merges array<array<int>>, long array<binary>")


def coded_words(docs: DataFrame, path: str) -> DataFrame:
    """Steps 1 and 2: rows of word numbers, after rows with the tokens (characters) of each new word; long words are left as bytes."""
    coded = F.zip_with("new", "merges", lambda w, m: fold_merges(w, m, path)).alias("tokens")
    return numbered_words(docs, path).select("doc_id", "words", "fresh", coded, "long")


def _assembled(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, np.ndarray | None, list[str] | None]]:
    """Step 3: (doc_id, word numbers, None) of a document, (None, None, tokens of new words), or three None where numbering starts anew."""
    for batch in batches:
        ids, words = batch.column("doc_id").to_pylist(), batch.column("words")
        fresh, tokens, long = (batch.column(c) for c in ("fresh", "tokens", "long"))
        for i in range(batch.num_rows):
            if words[i].is_valid:
                yield ids[i], words[i].values.to_numpy(), None
            else:
                if fresh[i].as_py():
                    yield None, None, None
                rest = iter(long[i].as_py())
                yield None, None, [t or "".join(map(chr, heap_merges(next(rest), ranks_of(path)))) for t in tokens[i].as_py()]


class Dictionary:
    """The ids of the words known so far, end to end in one array: a tenth of what a list for each word takes."""

    def __init__(self) -> None:
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        """Words as characters of their tokens."""
        self.ids = np.concatenate([self.ids, np.frombuffer("".join(words).encode("utf-32-le"), np.int32)])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def text(self, words: np.ndarray) -> np.ndarray:
        """The ids of a text, given as numbers of its words."""
        sizes = self.ends[words + 1] - self.ends[words]
        return self.ids[np.repeat(self.ends[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def batch(rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[1] for r in rows])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(sizes), ids], schema=schema)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary()
        rows: list[tuple[int | None, np.ndarray]] = []
        size = 0
        for doc_id, words, new in _assembled(batches, path):
            if words is not None:
                rows.append((doc_id, known.text(words)))
                size += len(rows[-1][1])
                if size > 500_000:
                    yield batch(rows)
                    rows, size = [], 0
            elif new is None:
                known = Dictionary()
            else:
                known.add(new)
        if rows:
            yield batch(rows)

    return coded_words(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of each row's ids: binary pieces laid end to end (an id without a piece adds nothing)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {rank: token for token, rank in ranks_of(path).items()}
        for batch in batches:
            data = [None if ids is None else b"".join(piece.get(i, b"") for i in ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(data, pa.binary())], ["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoding and decoding in one pass, ids never leave the task.

    A word's ids are written, and its tokens' bytes concatenated, once per dictionary; a document joins those."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {rank: token for token, rank in ranks_of(path).items()}
        digits = {rank: b"%d" % rank for rank in piece}
        written: list[bytes] = []
        decoded: list[bytes] = []
        lengths: list[int] = []
        rows: list[tuple] = []
        for doc_id, words, new in _assembled(batches, path):
            if words is not None:
                words = words.tolist()
                ids = sha256(b" ".join(map(written.__getitem__, words))).hexdigest()
                data = sha256(b"".join(map(decoded.__getitem__, words))).hexdigest()
                rows.append((doc_id, sum(map(lengths.__getitem__, words)), ids, data))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            elif new is None:
                written, decoded, lengths = [], [], []
            else:
                written += [b" ".join(map(digits.__getitem__, map(ord, word))) for word in new]
                decoded += [b"".join(map(piece.__getitem__, map(ord, word))) for word in new]
                lengths += map(len, new)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return coded_words(docs, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
