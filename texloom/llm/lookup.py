"""Scoring texts against a model kept as a table of entries (kind, gram, col, value).

A table of at most `BROADCAST_ENTRIES` entries is sent to every task as sorted arrays. A larger one stays a table: the
documents are dealt to slices of about `SLICE_BYTES` of text, each slice's distinct grams are joined with the table, and a
slice is scored with its own entries. A slice that copies of one row make too large is dealt on to several tasks, each with
all of the slice's entries. Both ways give the same rows; only what is in memory differs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import distinct, drop_written, release, released, slices

BROADCAST_ENTRIES, SLICE_BYTES = 4_000_000, 32 << 20
_SLICE, _SALT, _PARTS = "texloom slice", "texloom salt", "texloom parts"

#: kind -> the sorted distinct grams that a text asks for
Asked = dict[int, np.ndarray]


class Entries:
    """Sorted arrays of the entries of each kind; a gram may have an entry for each of several columns."""

    def __init__(self, kinds: np.ndarray, grams: np.ndarray, cols: np.ndarray, values: np.ndarray):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        grams = grams.view(np.uint64)
        for kind in distinct(kinds):
            own = np.flatnonzero(kinds == kind)
            own = own[np.lexsort((cols[own], grams[own]))]
            keys = distinct(grams[own])
            bounds = np.concatenate([np.searchsorted(grams[own], keys), [len(own)]]).astype(np.int32 if len(own) < 1 << 31 else np.int64)
            self.of[int(kind)] = keys, bounds, cols[own], values[own]

    @classmethod
    def read(cls, table: pa.Table) -> Entries:
        return cls(*(table.column(c).to_numpy() for c in ("kind", "gram", "col", "value")))

    @classmethod
    def collected(cls, table: DataFrame) -> Entries:
        """Of a bounded table, on the driver: its Arrow batches are gone before its columns are sorted."""
        found = table.select("kind", "gram", "col", "value").toArrow()
        columns = [np.array(found.column(c)) for c in found.column_names]
        del found
        release()
        return cls(*columns)

    def find(self, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (into `grams`), column and value of every entry of the grams."""
        none = np.zeros(0, np.int64)
        if kind not in self.of or not len(grams):
            return none, none, none
        keys, bounds, cols, values = self.of[kind]
        if int(keys[-1]) == len(keys) - 1:  # every number from 0 on
            at = np.minimum(grams, keys[-1]).astype(np.int64)
        else:
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        rows = np.flatnonzero(keys[at] == grams)
        first, n = bounds[at[rows]], bounds[at[rows] + 1] - bounds[at[rows]]
        index = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(rows, n), cols[index], values[index]


class Model:
    """A table of entries, sent to the tasks where its size allows that."""

    def __init__(self, table: DataFrame, bound: int = BROADCAST_ENTRIES):
        """`table` is a written one (see common.written): kind int, gram long, col int, value float or double."""
        self.table, self.shared = table, None
        if table.count() <= bound:
            self.shared = table.sparkSession.sparkContext.broadcast(Entries.collected(table))
            release()  # the driver only keeps the name of the file that the entries were sent by
            drop_written(table)

    def score(self, docs: DataFrame, asked: Callable[[pa.RecordBatch], Asked], answer: Callable[[pa.RecordBatch, Entries], pa.RecordBatch], schema: str | StructType) -> DataFrame:
        """`answer` of every slice of `docs` (which has a column text), as rows of `schema`."""
        if self.shared is not None:
            shared = self.shared

            @released
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in slices(batches):
                    yield answer(part, shared.value)

            return docs.mapInArrow(run, schema)
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        own = [c for c in ("doc_id", "text") if c in docs.columns]
        marked = docs.withColumn(_SLICE, F.pmod(F.xxhash64(*own), F.lit(1 + size // SLICE_BYTES)).cast("int"))

        @released
        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in np.unique(batch.column(_SLICE).to_numpy()):
                    for part in slices([batch.filter(pc.equal(batch.column(_SLICE), k))]):
                        for kind, keys in asked(part).items():
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64))], [_SLICE, "kind", "gram"])

        # at most a row for each SLICE_BYTES of text: the slices that need more than one task
        parts = (1 + F.sum(F.octet_length("text")) / SLICE_BYTES / 2).cast("int")
        heavy = F.broadcast(marked.groupBy(_SLICE).agg(F.coalesce(parts, F.lit(1)).alias(_PARTS)).filter(F.col(_PARTS) > 1))
        n = F.coalesce(_PARTS, F.lit(1))
        needed = marked.mapInArrow(grams, f"`{_SLICE}` int, kind int, gram long").distinct()
        entries = needed.join(self.table, ["kind", "gram"]).join(heavy, _SLICE, "left").select(_SLICE, F.explode(F.sequence(F.lit(0), n - 1)).alias(_SALT), "kind", "gram", "col", "value")
        dealt = marked.join(heavy, _SLICE, "left").withColumn(_SALT, F.floor(F.rand() * n).cast("int")).drop(_PARTS)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            found = Entries.read(right)
            rows = left.drop_columns([_SLICE, _SALT]).combine_chunks().to_batches()
            return pa.Table.from_batches([answer(part, found) for part in slices(rows)], None) if left.num_rows else pa.table({})

        return dealt.groupBy(_SLICE, _SALT).cogroup(entries.groupBy(_SLICE, _SALT)).applyInArrow(both, schema)


class Tally:
    """Counts of (group, key) in one task: at most about `limit` keys are held, then handed on."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.held, self.fresh = limit, {}, 0

    def add(self, group: str, keys: np.ndarray) -> None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self._merge(group, keys[first], np.diff(np.concatenate([first, [len(keys)]])))

    def _merge(self, group: str, keys: np.ndarray, counts: np.ndarray) -> None:
        if group in self.held:
            keys, counts = np.concatenate([self.held[group][0], keys]), np.concatenate([self.held[group][1], counts])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.add.reduceat(counts, first) if len(first) else counts
            keys = keys[first]
        self.held[group] = keys, counts

    def full(self) -> bool:
        return sum(len(k) for k, _ in self.held.values()) > self.limit

    def rows(self, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        for group, (keys, counts) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], list(names))
        self.held = {}
