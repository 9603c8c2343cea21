"""Token counts of whole texts: overlap resynchronisation.

A text longer than `chunk_chars` is encoded in overlapping chunks whose token boundaries carry offsets. Two neighbours are
spliced at a boundary that both of them have and that lies a guard away from either cut: a match of the splitting pattern
that ended at p ended because of a character that the left chunk sees, and a scan that stands at p depends only on what
follows, so both go on alike. Where no such boundary exists (one word longer than the overlap), the overlap is doubled.

Results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids each give a row; extra columns are
not read. Work per row is a narrow map: no shuffle, and at most one text with one chunk's boundaries is held at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import released, slices
from .pretoken import pattern_for

CHUNK_CHARS, OVERLAP_CHARS, CACHE_PIECES = 32_768, 512, 400_000


class ChunkCounter:
    """Counts by one tokenizer file; the counts of recent pieces are kept, up to `CACHE_PIECES`."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.guard = max(map(len, specials), default=1) + 1
        self.known: dict[str, int] = dict.fromkeys(specials, 1)
        self.fixed = dict(self.known)

    def split(self, text: str) -> list[str]:
        """Special strings, and between them the matches of the pattern."""
        if not self.specials or not self.specials.search(text):
            return pattern_for(text).findall(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += pattern_for(text[at : m.start()]).findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + pattern_for(text[at:]).findall(text[at:])

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_PIECES:
            self.known, new = dict(self.fixed), [w for w in words if w not in self.fixed]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = len(e.ids)

    def counts(self, text: str) -> tuple[list[str], list[int]]:
        words = self.split(text)
        self.learn(set(words))
        return words, list(map(self.known.__getitem__, words))

    def boundaries(self, text: str, start: int, stop: int) -> dict[int, int]:
        """Offsets in the text at which the chunk's pieces end, with the tokens up to there."""
        words, n = self.counts(text[start:stop])
        return dict(zip((start + x for x in accumulate(map(len, words))), accumulate(n), strict=True)) | {start: 0}

    def spliced(self, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
        """Tokens of a long text, the chunks used, and how often an overlap was widened."""
        guard, total, widened, chunks = self.guard, 0, 0, 1
        begin, stop = 0, min(len(text), chunk)
        left, here = self.boundaries(text, begin, stop), 0
        while stop < len(text):
            wide, joint, right = overlap, None, {}
            while joint is None:
                start = max(begin, stop - wide)
                nxt = min(len(text), start + max(chunk, 2 * wide))
                right = self.boundaries(text, start, nxt)
                # a boundary below the guard of the right chunk, or within the guard of the left one's end, proves nothing
                joint = max((p for p in left if start + guard <= p <= stop - guard and p >= here and p in right), default=None)
                if joint is None:
                    widened += 1
                    if start == begin:  # the whole left chunk is one word: let it reach further
                        stop = min(len(text), stop + max(chunk, stop - begin))
                        left = self.boundaries(text, begin, stop)
                        if stop == len(text):
                            return total + left[stop] - left[here], chunks, widened
                    wide *= 2
            total += left[joint] - left[here]
            left, begin, stop, here = right, start, nxt, joint
            chunks += 1
        return total + left[stop] - left[here], chunks, widened


@lru_cache(maxsize=4)
def counter(path: str) -> ChunkCounter:
    return ChunkCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, n_chunks and n_widened of each row of `docs` (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chunks", pa.int32()), ("n_widened", pa.int32())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_path)
        for part in slices(batches):
            tokens, chunks, widened = [], [], []
            texts = part.column("text").to_pylist()
            short = [c.split(t) if t and len(t) <= chunk_chars else () for t in texts]
            c.learn(set().union(*short))
            get = c.known.__getitem__
            totals = [sum(map(get, words)) for words in short]  # before a long text may clear what is known
            for t, n in zip(texts, totals, strict=True):
                if t and len(t) > chunk_chars:
                    n, k, w = c.spliced(t, chunk_chars, overlap_chars)
                else:
                    k, w = 1, 0
                tokens.append(n), chunks.append(k), widened.append(w)
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), size, pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int")
