"""Exact top-k search by a pivot-distance index.

Vectors are quantised to integers, and the largest inner product is the nearest neighbour after one more coordinate,
sqrt(M^2 - |v|^2) with M the longest norm (0 for a query). Each vector is keyed by its nearest pivot and its distance from
it; rows sorted by that key are cut into blocks, annuli about their pivot. A query first searches the annulus it lies in,
which gives it a score to beat. By the triangle inequality a vector at distance r from a pivot is at least |d - r| from a
query at distance d, which bounds its score: only annuli within the query's reach d - s to d + s can hold a better one.
The annuli in reach are searched in rings, the nearest first; after each ring the scores to beat rise, the reach shrinks,
and what it no longer meets is not read. Ties with the score to beat are searched too, so the result is exact (recall 1).

Which annuli a block of queries reaches is decided on their keys alone (a few numbers each, dealt by pivot and salt);
vectors meet only in the pairs that remain. The pivots are up to `PIVOTS` vectors of the smallest hash (a bounded sample);
every vector is indexed. A hot vector's copies fill many blocks, since the key ends with the id.

Results: vectors that are null or have null or non-finite components take no part, nor do doubles of 1e150 and more, whose
squares overflow; a shorter vector counts as filled up with zeros, an empty one too; scores beyond a long are held at its
ends; rows of one id are separate candidates, but a query never meets its own id; equal query rows are one query, query
rows of one id with different vectors are queries of their own; fewer candidates than k give fewer rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

PIVOTS, BLOCK, QUERY_BLOCK, SCALE, RINGS, SALT = 64, 2048, 256, 256, 3, 16


def quantised(vectors: DataFrame, query: Column) -> DataFrame:
    """vec_id, v (whole numbers as doubles), is_query of the vectors that take part."""
    x = F.col("embedding")
    scaled = lambda c: c.cast("double") * SCALE
    # doubles of 2^53 and more are whole numbers already
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < float(1 << 53), F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(1e150)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite)
    return rows.select("vec_id", whole.alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _packed(v: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them all, named by the first byte."""
    top = np.abs(v).max(initial=0)
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "d"
    return kind.encode() + v.astype(kind).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(data[:1].decode()), offset=1).reshape(-1, width).astype(np.float64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where every partial sum fits them, else in longs or Python integers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Pivots:
    def __init__(self, points: np.ndarray, longest: int):
        self.points, self.longest = points.astype(np.float64), float(longest)
        norms = (self.points**2).sum(1)
        self.extra, self.squares = np.sqrt(np.maximum(self.longest - norms, 0)), norms

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """From each row to each pivot, in the space with the added coordinate."""
        own = (v**2).sum(1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest - own, 0))
        squared = (own + extra**2)[:, None] + (self.squares + self.extra**2)[None, :] - 2 * (v @ self.points.T + extra[:, None] * self.extra[None, :])
        return np.sqrt(np.maximum(squared, 0))


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties to the smaller id, without the query's own."""
    ok = ids != own
    scores, ids = scores[ok], ids[ok]
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(scores[i]), int(ids[i])) for i in order]


def _index(rows: DataFrame, pivots: Pivots, width: int, k: int) -> DataFrame:
    """A row for each annulus: block, pivot, r_lo, r_hi, ids, v, and the queries in it with the score each has to beat."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pivots.distances(_matrix(b.column("v"), width), False)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("is_query"), pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])], ["vec_id", "v", "is_query", "pivot", "r"])

    def annuli(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block each: consecutive vectors of one pivot."""
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        made = TaskContext.get().partitionId() << 33
        met: dict = {}  # the vectors asked for by the last key

        def out() -> pa.RecordBatch:
            nonlocal made
            pivot = held[0][0]
            ids, v, q, r = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            held.clear()
            q = q.copy()
            for i in np.flatnonzero(q):  # equal rows have equal keys, so they follow each other in one partition
                if met.get("key") != (pivot, r[i], ids[i]):
                    met.update(key=(pivot, r[i], ids[i]), vectors=set())
                q[i] = (own := v[i].tobytes()) not in met["vectors"]
                met["vectors"].add(own)
            seeds, at = [], np.flatnonzero(q)
            if len(at):
                scores = _dot(v[at], v)
                for i, s in zip(at, scores, strict=True):
                    best = _best(s, ids, ids[i], k)
                    seeds.append(best[-1][0] if len(best) == k else None)
            made += 1
            values = [pa.array([made]), pa.array([pivot], pa.int32()), pa.array([float(r.min())]), pa.array([float(r.max())]), pa.array([ids.astype(np.int64).tobytes()]), pa.array([_packed(v)]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([seeds], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(values, ["block", "pivot", "r_lo", "r_hi", "ids", "v", "queries", "seeds"])

        for b in batches:
            piv, ids, q, r = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "vec_id", "is_query", "r"))
            v = _matrix(b.column("v"), width)
            at = 0
            while at < len(piv):
                if held and (held[0][0] != piv[at] or sum(len(h[1]) for h in held) >= BLOCK):
                    yield out()
                room = BLOCK - sum(len(h[1]) for h in held)
                stop = min(at + room, int(np.searchsorted(piv, piv[at], "right")))
                held.append((int(piv[at]), ids[at:stop], v[at:stop], q[at:stop], r[at:stop]))
                at = stop
        if held:
            yield out()

    key = rows.mapInArrow(keyed, "vec_id long, v array<double>, is_query boolean, pivot int, r double")
    ordered = key.repartitionByRange("pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")
    return ordered.mapInArrow(annuli, "block long, pivot int, r_lo double, r_hi double, ids binary, v binary, queries array<int>, seeds array<long>")


def _questions(index: DataFrame, pivots: Pivots, width: int) -> DataFrame:
    """A row for each query: its block of queries (neighbours in the index), square, distances from the pivots, first floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            for r in b.to_pylist():
                at = np.array(r["queries"], int)
                ids, v = np.frombuffer(r["ids"], np.int64)[at], _unpacked(r["v"], width)[at]
                asks = base + seen + np.arange(len(at))
                group = base + (seen + np.arange(len(at))) // QUERY_BLOCK
                seen += len(at)
                d = pivots.distances(v, True)
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(asks), pa.array(ids), pa.array([_packed(x) for x in v], pa.binary()), pa.array((v**2).sum(1)), pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(r["seeds"], pa.int64())], ["q_block", "ask", "query_id", "q", "square", "d", "seed"])

    asking = index.filter(F.size("queries") > 0).select("ids", "v", "queries", "seeds")
    return asking.mapInArrow(run, "q_block long, ask long, query_id long, q binary, square double, d array<double>, seed long")


def _reach(asked: DataFrame, longest: float) -> DataFrame:
    """For each block of queries and pivot the distances that its queries can reach (lo, hi), and their own (d_lo, d_hi).

    A score of at least the floor means a square distance of at most |q|^2 + M^2 - 2 floor; rounding is allowed for."""
    square, floor, d = F.col("square") + longest, F.col("floor").cast("double"), F.col("distance")
    within = F.sqrt(F.greatest(square - 2 * floor, F.lit(0.0)) + 1e-9 * (square + F.abs(floor)) + 1e-6) + 1e-6 * (1 + d)
    within = F.coalesce(within, F.lit(float("inf")))
    points = asked.select("q_block", "square", "floor", F.posexplode("d").alias("pivot", "distance"))
    return points.groupBy("q_block", "pivot").agg(F.min(d - within).alias("lo"), F.max(d + within).alias("hi"), F.min(d).alias("d_lo"), F.max(d).alias("d_hi"))


def search(vectors: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's best candidates."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, query))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(norm).alias("longest")).first()
    if not shape.width:  # no vector, or none with a component
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = shape.width
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))
    full = rows.withColumn("v", F.when(F.size("v") < width, filled).otherwise(F.col("v")))
    points = np.array([r.v for r in full.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()])
    pivots = Pivots(np.unique(points, axis=0), shape.longest)
    index = written(_index(full, pivots, width, k))
    asked = written(_questions(index, pivots, width))

    # which annuli each block of queries reaches, on keys alone; the ring is the share of the reach that lies between them
    apart = F.greatest(F.col("r_lo") - F.col("d_hi"), F.col("d_lo") - F.col("r_hi"), F.lit(0.0))
    reach = F.greatest(F.col("hi") - F.col("d_hi"), F.lit(1e-9))
    ring = F.when(apart <= 0, 0).otherwise(F.least(1 + F.floor(apart / reach * RINGS), F.lit(RINGS))).cast("int")
    salted = index.select("block", "pivot", "r_lo", "r_hi", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int").alias("salt"))
    floors = asked.select("ask", F.col("seed").alias("floor"))
    ranges = _reach(asked.join(floors, "ask"), pivots.longest).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    meet = (F.col("r_lo") <= F.col("hi")) & (F.col("r_hi") >= F.col("lo"))
    pairs = written(ranges.join(salted, ["pivot", "salt"]).filter(meet).select("q_block", "block", "pivot", "r_lo", "r_hi", ring.alias("ring")))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int, int, int]] = []
            for i in range(b.num_rows):
                ids, v = np.frombuffer(b.column("ids")[i].as_py(), np.int64), _unpacked(b.column("v")[i].as_py(), width)
                asks = b.column("asks")[i].as_py()
                scores = _dot(np.concatenate([_unpacked(a["q"], width) for a in asks]), v)
                for a, s in zip(asks, scores, strict=True):
                    own, least = a["query_id"], a["floor"]
                    found += [(a["ask"], own, to, score) for score, to in _best(s, ids, own, k) if least is None or score >= least]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["ask", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    best = None
    for turn in sorted(r.ring for r in pairs.select("ring").distinct().collect()):
        if best is not None:
            # the k-th score found so far is the new score to beat
            kth = best.filter(F.col("rank") == k).select("ask", "score")
            floors = asked.join(kth, "ask", "left").select("ask", F.greatest("seed", "score").alias("floor"))
        now = asked.join(floors, "ask")
        left = pairs.filter(F.col("ring") == turn)
        if best is not None:
            left = left.join(_reach(now, pivots.longest), ["q_block", "pivot"]).filter(meet)
        asks = now.groupBy("q_block").agg(F.collect_list(F.struct("ask", "query_id", "q", "floor")).alias("asks"))
        together = left.select("q_block", "block").join(asks, "q_block").join(index.select("block", "ids", "v"), "block").select("ids", "v", "asks")
        found = together.mapInArrow(answered, "ask long, query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.select("ask", "query_id", "vec_id", "score"))
        before, best = best, written(found.select("ask", "query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k))
        if before is not None:
            drop_written(before)
    drop_written(rows, index, asked, pairs)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.drop("ask")
