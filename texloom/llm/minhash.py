"""Near-duplicate documents: min-max hashing, banding, confirmation on full sets, components.

Each of `PERMUTATIONS` hash functions gives a set's minimum and its maximum, so half the evaluations give a signature of
2 * PERMUTATIONS values. A band is five minima and five maxima: with 96 bands of ten values a pair at similarity 0.8 is
missed with probability (1 - 0.8^10)^96 < 2e-5 (at 0.85 under 1e-9), while texts that share a long passage and no more (0.5)
meet in a tenth of the cases: bands of fewer values would bring thousands of such texts together.

Documents of equal sets are one class from the start (they are never expanded into pairs). Within a bucket (classes that
share a band) every member is confirmed against one pivot, the member that meets the most others; a pair of member and
pivot is confirmed once, in however many buckets it meets. Members that link with their pivot are connected by that. What
may be missing then are the links of the others, the outsiders: each group (a pivot and all that met it) with outsiders is
searched once more, by an inverted index over the group's full sets which counts what an outsider has in common with every
member. So each link that shares a band is found, or its two ends are connected already. A group is searched in cells of at
most `CELL_SHINGLES` shingles a side (a longer set comes alone), so a task's memory is bounded at any size of group; a cell
returns at most one link for each two parts that it connects, never its pairs.

Results: a null or empty text, or one without words, has no shingle and links with nothing; a null doc_id takes no part
(component_id null, kept false); equal rows are one class; rows of one doc_id with different texts are judged row by row
(each has the component of its own text); extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, distinct, drop_written, joined, mix, per_document, released, slices, texts_of, words_of, written
from .components import components

PERMUTATIONS, BAND_PAIRS, THRESHOLD = 480, 5, 80
CELL_SHINGLES, BROADCAST_NODES = 1_000_000, 2_000_000


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the runs of `size` words, sorted; fewer words are one shingle, no word is none."""
    if not len(hashes):
        return hashes
    n = min(size, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = combine(out, hashes[i : len(hashes) - n + 1 + i])
    return distinct(out)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    return (seeds[:n] | np.uint32(1))[:, None], seeds[n:][:, None]


_A, _B = _coefficients(PERMUTATIONS)


def signature(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of the set under each permutation (of 32-bit hashes), in pieces that stay in the cache."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 256):
            h = _A * short[None, at : at + 256]
            h += _B
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bucket key for each band; the band's number is part of it."""
    key = np.arange(PERMUTATIONS // BAND_PAIRS, dtype=np.uint64)
    for i in range(BAND_PAIRS):
        both = low[i::BAND_PAIRS].astype(np.uint64) << np.uint64(32) | high[i::BAND_PAIRS]
        key = combine(key, both)
    return key


def _sets(part: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    data, offsets = joined([t.lower() if t else t for t in texts_of(part)])  # bytes.lower() changes A-Z only
    starts, _, hashes = words_of(data)
    at = per_document(starts, offsets)
    for i in range(part.num_rows):
        yield shingles(hashes[at[i] : at[i + 1]], size)


def sketches(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, two 64-bit sums that name the set (null for an empty one) and its bands."""
    names = ["doc_id", "h", "n_shingles", "k1", "k2", "bands"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, k1, k2, keys = [], [], [], []
            for values in _sets(part, size):
                n.append(len(values))
                if len(values):
                    with np.errstate(over="ignore"):
                        k1.append(int(mix(values).sum(dtype=np.uint64).view(np.int64)))
                        k2.append(int(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(bands(*signature(values)).view(np.int64))
                else:
                    k1.append(None), k2.append(None), keys.append(None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("h"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and the whole shingle set of each row of `docs` (node, text)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [s.view(np.int64) for s in _sets(part, size)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """x, p, nx (size of x's set) and near (whether they link) of each pair, on full sets."""
    first = sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx"))
    second = sets.select(F.col("node").alias("p"), F.col("shingles").alias("sp"))
    both = pairs.join(first, "x").join(second, "p")
    counted = both.select("x", "p", F.size(F.array_intersect("sx", "sp")).cast("long").alias("common"), F.size("sx").cast("long").alias("nx"), F.size("sp").cast("long").alias("np"))
    return counted.select("x", "p", "nx", (100 * F.col("common") >= threshold * (F.col("nx") + F.col("np") - F.col("common"))).alias("near"))


def _cell_links(x: np.ndarray, values: np.ndarray, offsets: np.ndarray, member: np.ndarray, outsider: np.ndarray, near: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that connect the outsiders of a cell with its members; those near the group's pivot are one part already."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(x)), sizes)
    vocabulary = distinct(values)
    codes = np.searchsorted(vocabulary, values)
    inside = member[row]
    order = np.argsort(codes[inside], kind="stable")
    posting = row[inside][order]  # the members that have a shingle, shingle by shingle
    ends = np.cumsum(np.bincount(codes[inside], minlength=len(vocabulary)))
    begins = np.concatenate([[0], ends[:-1]])
    parent = np.arange(len(x))
    if near.any():
        parent[near] = np.flatnonzero(near)[0]

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in np.flatnonzero(outsider):
        own = codes[offsets[i] : offsets[i + 1]]
        n = ends[own] - begins[own]
        at = np.repeat(begins[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(posting[at], minlength=len(x))
        linked = member & (100 * common >= threshold * (sizes[i] + sizes - common))
        linked[i] = False
        for j in np.flatnonzero(linked):
            a, b = top(i), top(j)
            if a != b:
                parent[a] = b
                out.append((int(x[i]), int(x[j])))
    return out


def outsider_links(judged: DataFrame, sets: DataFrame, threshold: int, cell: int = CELL_SHINGLES) -> DataFrame:
    """a, b: links of the members that do not link with the pivot of their group; `judged` as from `confirmed`."""
    far = ~F.col("near")
    groups = judged.groupBy("p").agg(F.count("*").alias("n"), F.count_if(far).alias("far"), F.sum("nx").alias("all"), F.sum(F.when(far, F.col("nx")).otherwise(0)).alias("out"))
    groups = groups.filter("far > 0 and n > 1").select("p", F.ceil(F.col("all") / cell).cast("int").alias("nm"), F.ceil(F.col("out") / cell).cast("int").alias("no"))
    rows = judged.select("p", "x", "near").join(groups, "p")
    m, o = F.pmod(F.xxhash64("x"), "nm").cast("int"), F.pmod(F.xxhash64("x", F.lit(1)), "no").cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_member = F.transform(every("no"), lambda k: F.struct(m.alias("m"), k.alias("o")))
    as_outsider = F.when(F.col("near"), F.array().cast("array<struct<m:int,o:int>>")).otherwise(F.transform(every("nm"), lambda k: F.struct(k.alias("m"), o.alias("o"))))
    cells = rows.select("p", "x", "near", m.alias("own_m"), o.alias("own_o"), F.explode(F.array_distinct(F.concat(as_member, as_outsider))).alias("c"))
    cells = cells.select("p", "c.m", "c.o", "x", "near", (F.col("c.m") == F.col("own_m")).alias("member"), (~F.col("near") & (F.col("c.o") == F.col("own_o"))).alias("outsider"))
    filled = cells.join(sets.withColumnRenamed("node", "x"), "x")

    def run(group: pa.Table) -> pa.Table:
        column = lambda c: group.column(c).to_numpy()
        lists = group.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = _cell_links(column("x"), lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0], column("member"), column("outsider"), column("near"), threshold)
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(2)], ["a", "b"])

    return filled.groupBy("p", "m", "o").applyInArrow(run, "a long, b long")


def grouped(classes: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame | None:
    """node and component of the classes that have a link; None if no two classes share a band."""
    members = classes.select(F.col("node").alias("x"), F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(members.join(crowded, "bucket"))
    # how many others a member meets over all bands: the centre of a group of copies meets the most
    nodes = written(members.groupBy("x").agg(F.sum("n").alias("weight")))
    if not (met := nodes.count()):
        return None
    pivots = members.join(nodes, "x").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("x")).alias("low"))).alias("top"))
    pivots = pivots.select("bucket", (-F.col("top.low")).alias("p"))
    probes = written(members.join(pivots, "bucket").filter("x <> p").select("x", "p").distinct())
    wanted = classes.join(nodes.select(F.col("x").alias("node")), "node", "left_semi").select("node", "doc_id", "h")
    wanted = F.broadcast(wanted) if met <= BROADCAST_NODES else wanted
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(wanted, ["doc_id", "h"])
    sets = written(full_sets(texts.dropDuplicates(["node"]), size))
    judged = written(confirmed(probes, sets, threshold))
    links = written(judged.filter("near").select(F.col("x").alias("a"), F.col("p").alias("b")).unionByName(outsider_links(judged, sets, threshold)))
    drop_written(members, nodes, probes, sets, judged)
    label = components(links)
    drop_written(links)
    return label


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept and h (hash of the text) of each row.

    `threshold` is in hundredths."""
    rows = written(sketches(docs, size))
    keyed = rows.filter("doc_id is not null and k1 is not null")
    classes = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "h", "bands")).alias("one"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "one.doc_id", "one.h", "one.bands"))
    label = grouped(classes, docs, size, threshold)
    names = classes.select("k1", "k2", "node", "doc_id")
    if label is not None:
        part = names.join(label, "node", "left").select("k1", "k2", "doc_id", F.coalesce("component", "node").alias("part"))
        least = part.groupBy("part").agg(F.min("doc_id").alias("component"))
        names = part.join(least, "part").select("k1", "k2", "component")
    else:
        names = names.select("k1", "k2", F.col("doc_id").alias("component"))
    out = rows.select("doc_id", "h", "n_shingles", "k1", "k2").join(names, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "h")


def kept_rows(docs: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns: of each group the row of the smallest doc_id, of repeated rows one.

    Rows with a null doc_id take no part and stay."""
    fresh = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    kept = near_duplicates(docs.select("doc_id", "text"), size, threshold).filter("kept").select(F.col("doc_id").alias(fresh + "id"), F.col("h").alias(fresh + "h")).distinct()
    one = docs.join(kept, (F.col("doc_id") == F.col(fresh + "id")) & (F.xxhash64("text") == F.col(fresh + "h")), "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.filter("doc_id is null")).select(*docs.columns)
