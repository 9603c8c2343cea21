"""Resharding by minimum-cost flow: old shard sizes, new capacities, and the block transfers that move the fewest bytes.

The law is `bytes`: sizes are near equal. The flow is solved on shards alone (their number is a parameter), so it is exact
and small at any data size. Every old shard's rows are laid in one order, by hash bucket and then by id, and the flow cuts
that line into blocks of consecutive rows; a row goes where its middle byte lies, so a shard's size is off by less than
one row for each block. Positions come from one shuffle by bucket and from prefix sums over the bucket totals, so neither
a shard nor an old shard is ever in one task.

Results: a null text has size 1 (no bytes, plus 1) and CRC-32 0; equal rows are placed one by one (copies may be parted,
which keeps a hot text from filling a shard); rows with null ids are placed like others; extra columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

ROWS_PER_BUCKET, MIN_BUCKETS, BROADCAST_BUCKETS = 20_000, 256, 1 << 17


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink, of least total cost (successive shortest paths on the residual network).

    Every unit of supply is sent; the capacities must hold it. Ties go to the first path found, so the result is fixed."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new capacities do not hold the old shards")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        source = next(i for i in range(n) if left[i])
        # Bellman-Ford by a queue from this source over sources 0..n-1 and sinks n..n+m-1
        far = [None] * (n + m)
        via = [-1] * (n + m)
        far[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                if far[v] is None or far[u] + c < far[v]:
                    far[v], via[v] = far[u] + c, u
                    queue.append(v)
        sink = min((n + j for j in range(m) if room[j]), key=lambda v: (far[v], v))
        path = [sink]
        while path[-1] != source:
            path.append(via[path[-1]])
        path.reverse()
        amount = min(left[source], room[sink - n], *(flow[v][u - n] for u, v in zip(path, path[1:], strict=False) if u >= n))
        for u, v in zip(path, path[1:], strict=False):
            if u < n:
                flow[u][v - n] += amount
            else:
                flow[v][u - n] -= amount
        left[source] -= amount
        room[sink - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def transfers(sizes: dict[int, int], shards: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(old shard, new shard, first byte, end byte) of each block on the old shards' lines, and the bytes that move.

    An old shard keeps its number where it has a new shard of that number; what stays comes first on its line."""
    old = sorted(sizes)
    cost = [[0 if i == j else 1 for j in range(shards)] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], equal_capacities(sum(sizes.values()), shards), cost)
    blocks, moved = [], 0
    for row, i in enumerate(old):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if flow[row][j]:
                blocks.append((i, j, at, at + flow[row][j]))
                at += flow[row][j]
                moved += flow[row][j] * (i != j)
    return blocks, moved


def _before(totals: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Sums over the buckets before each bucket; at most one row for each bucket and shard."""
    order = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("bucket", by, *(F.coalesce(F.sum(v).over(order), F.lit(0)).alias(f"{v}_before") for v in values))


def reshard(docs: DataFrame, old_shard: Column, shards: int, with_rows: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in each shard) of each row of `docs`; `with_rows` adds
    row, a struct of all the row's columns, which `rewrite` needs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [F.struct(*docs.columns).alias("row")] if with_rows else []
    rows = docs.select(*own, F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"))
    n = docs.count()
    buckets = max(MIN_BUCKETS, n // ROWS_PER_BUCKET)
    # equal rows of one id are told apart by nothing, and may stand in any order; rows without an id are dealt by their text
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "text_crc32", F.when(F.col("id").isNull(), F.col("size"))), F.lit(buckets)).cast("int"))
    old = written(rows.groupBy("bucket", "old_shard").agg(F.sum("size").alias("size")))
    sizes = {r.old_shard: r.size for r in old.groupBy("old_shard").agg(F.sum("size").alias("size")).collect()}
    blocks, _ = transfers(sizes, shards)
    before = _before(old, "old_shard", ["size"])
    placed = rows.join(F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before, ["bucket", "old_shard"])
    line = Window.partitionBy("bucket", "old_shard").orderBy("id", "text_crc32", "size")
    middle = F.col("size_before") + F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.ceil(F.col("size") / 2).cast("long")
    placed = placed.withColumn("middle", middle)
    shard = F.lit(None).cast("int")
    for i, j, first, end in blocks:
        shard = F.when((F.col("old_shard") == i) & (F.col("middle") >= first) & (F.col("middle") < end), F.lit(j)).otherwise(shard)
    placed = written(placed.select(*(["row"] if with_rows else []), "id", "size", "text_crc32", "old_shard", "bucket", shard.alias("shard")))
    new = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = _before(new, "shard", ["n"])
    slotted = placed.join(F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before, ["bucket", "shard"])
    slot = F.col("n_before") + F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("id", "text_crc32", "size")) - 1
    drop_written(old)
    return slotted.select(*(["row"] if with_rows else []), F.col("id").alias("doc_id"), "size", "text_crc32", "old_shard", "shard", slot.cast("long").alias("slot"))


def affected(plan: DataFrame) -> list[int]:
    """The shards that gain or lose rows; at most one number for each old and new shard comes to the driver."""
    changed = plan.filter("old_shard <> shard")
    return sorted(r[0] for r in changed.select(F.explode(F.array("old_shard", "shard"))).distinct().collect())


def rewrite(plan: DataFrame, path: str, rows_per_file: int = 100_000) -> list[int]:
    """Write the files of the affected shards, one folder a shard, in slot order; returns those shards.

    `plan` is from `reshard` with rows: it carries them itself, so null and repeated ids are written like others."""
    touched = affected(plan)
    rows = plan.filter(F.col("shard").isin(touched)).withColumn("part", F.floor(F.col("slot") / rows_per_file))
    # a column named like the folder's is the folder's
    flat = rows.select("shard", "slot", "part", *(F.col(f"row.{c}") for c in plan.schema["row"].dataType.names if c not in ("shard", "slot", "part")))
    flat.repartition("shard", "part").sortWithinPartitions("shard", "slot").drop("part").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").mode("overwrite").parquet(path)
    return touched
