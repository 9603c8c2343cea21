"""Merkle manifest of a dataset: a tree of digests over each source's rows, one over the sources, and a proof for every row.

A node is named by its coordinates (tree, level, index); the nodes of all levels stand in one written table. A node finds
the coordinates of its siblings by arithmetic from its index and the group size, explodes them, and joins the node table;
the siblings of one node are then put in order and concatenated. Proofs are put together from the root down: a node's
proof is its own siblings and then its parent's proof, so that each row of a join meets at most `ARITY` others, whatever
share of all rows one source has. Rows are numbered by a range shuffle, counts of each range, and running sums of the
counts: no task holds a source. Digests are stored as 32 bytes and written as hex text where they are hashed.

Results: null values are hashed as `-`; a null source is a source of its own, before all others; a null doc_id comes
first in its source and is never tampered with; rows of equal source and doc_id are ordered by their digests, so repeated
rows have a place each and the same root in any order of input; extra columns, whatever their names, are not read; an
empty table gives no rows. A leaf without siblings has the digest of the empty string as proof_sha256.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

ARITY = 16
#: A table with a row for each source, or for each source and range, is broadcast up to so many rows.
BROADCAST_RANGES = 200_000
_POSITION = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def field(value: Column) -> Column:
    """A value as it is hashed: its length in bytes, a colon and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf(text: Column) -> Column:
    return digest_of(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the digest of the row with its letters lowered where 5 divides the id's CRC (else null)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(lowered(F.col("text")))).alias("tampered"))


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """`rows` with idx: its place (from 0) among the rows of equal `tree`, by the columns `order`."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = written(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION)).alias("_at")))
    ranges = placed.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_tree").orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ranges = written(ranges.select("_tree", "_r", (before - F.col("_first")).alias("_shift")))
    small = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    out = placed.join(small, (F.col(tree) == F.col("_tree")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_range", "_r", "_at", "_tree", "_shift")


def nodes(leaves: DataFrame) -> list[DataFrame]:
    """tree, level, idx, digest, n (nodes of this tree on this level) and row of the nodes of each level, from the leaves up.

    `leaves` is read from a written table and has tree, idx, digest, row (null above the leaves). Each level is written before
    the next is made from it; a tree has its root on the level where it has one node."""
    sizes = _sizes(leaves)
    levels = [leaves.join(sizes, "tree").select("tree", F.lit(0).alias("level"), "idx", "digest", "n", "row")]
    most = sizes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = levels[-1].filter("n > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        inside = F.concat_ws("", F.transform("run", lambda x: hex_text(x.digest)))
        levels.append(written(runs.select("tree", F.lit(len(levels)).alias("level"), "idx", digest_of(inside).alias("digest"), F.ceil(F.col("n") / ARITY).alias("n"), F.lit(None).cast("int").alias("row"))))
        most = -(-most // ARITY)
    return levels


def _sizes(leaves: DataFrame) -> DataFrame:
    """Nodes of each tree; sent to all tasks where it is small, so that a large tree's rows need no shuffle."""
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n")))
    return F.broadcast(sizes) if sizes.count() <= BROADCAST_RANGES else sizes


def asked_siblings(level: DataFrame) -> DataFrame:
    """tree, own, idx, digest: the siblings that each node of a level asks for by their coordinates; idx null if it has none."""
    first = F.col("idx") - F.pmod("idx", F.lit(ARITY))
    wanted = F.filter(F.sequence(first, F.least(first + (ARITY - 1), F.col("n") - 1)), lambda j: j != F.col("idx"))
    asked = level.filter("n > 1").select("tree", F.col("idx").alias("own"), F.explode_outer(wanted).alias("idx"))
    return asked.join(level.select("tree", "idx", "digest"), ["tree", "idx"], "left").select("tree", "own", "idx", "digest")


def step(run: str, own: str) -> Column:
    """The digests before and after a node in its run, concatenated."""

    def side(keep) -> Column:
        return F.aggregate(F.filter(run, keep), F.lit(b""), lambda done, x: F.concat(done, x.digest))

    return F.struct(side(lambda x: x.idx < F.col(own)).alias("before"), side(lambda x: x.idx > F.col(own)).alias("after"))


_PATH = "array<struct<before: binary, after: binary>>"


def proven(levels: list[DataFrame], top: DataFrame | None = None) -> DataFrame:
    """row and path: the steps from each leaf up to its tree's root, and then those of `top` (tree, path).

    From the root down each level's nodes get their siblings, and then their parent's path; both meet where the rows were
    dealt by their parents, so that no leaf's path is dealt itself."""
    above, sibling = None, F.struct("idx", "digest")
    for k in range(len(levels) - 1, -1, -1):
        kept, kind = levels[k], levels[k].schema["row"].dataType
        roots = kept.filter("n = 1").select("tree", "idx", "row")
        done = roots.withColumn("path", F.array().cast(_PATH)) if top is None else roots.join(top.select("tree", "path"), "tree")
        if above is not None:
            met = asked_siblings(levels[k]).select("tree", "own", F.when(F.col("idx").isNotNull(), sibling).alias("one"), F.lit(None).cast(kind).alias("row"), F.lit(False).alias("leaf"))
            carried = kept.filter("n > 1").select("tree", F.col("idx").alias("own"), F.lit(None).cast(met.schema["one"].dataType).alias("one"), "row", F.lit(True).alias("leaf"))
            dealt = met.unionByName(carried).withColumn("parent", F.shiftright("own", 4)).repartition("tree", "parent")
            runs = dealt.groupBy("tree", "parent", "own").agg(F.sort_array(F.collect_list("one")).alias("run"), F.max_by("row", "leaf").alias("row"))
            parents = above.select("tree", F.col("idx").alias("parent"), "path")
            here = runs.join(parents, ["tree", "parent"]).select("tree", F.col("own").alias("idx"), "row", F.concat(F.array(step("run", "own")), "path").alias("path"))
            done = here.unionByName(done)
        above = done if k == 0 else written(done.select("tree", "idx", "path"))
    return above


def folded(start: Column, path: Column) -> Column:
    """The root, as hex text, that a leaf and its proof lead to."""
    return F.aggregate(path, hex_text(start), lambda now, step: F.sha2(F.concat(hex_text(step.before), now, hex_text(step.after)), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root (bytes) and path of every row of `docs`."""
    rows = written(leaves(docs).withColumn("tie", F.monotonically_increasing_id()))  # equal rows are told apart by where they stand
    sources = numbered(rows.select("source").distinct().withColumn("tree", F.lit(0)), "tree", "source")
    sources = written(sources.select(F.col("idx").alias("tree"), "source"))
    ids = sources.select("tree", F.col("source").alias("_source"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_RANGES else ids
    placed = numbered(rows.join(ids, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "doc_id", "leaf", "tampered", "tie"), "tree", "doc_id", "leaf", "tie")
    drop_written(rows)
    low = nodes(placed.select("tree", "idx", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "tampered").alias("row")))
    tops = [level.filter("n = 1").select("tree", F.col("digest").alias("subroot")) for level in low]
    subroots = written(reduce(DataFrame.unionByName, tops))
    high = nodes(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.col("tree").alias("row")))
    root = F.broadcast(high[-1].filter("n = 1").select(F.col("digest").alias("root")))  # one row
    ends = subroots.crossJoin(root)
    top = written(proven(high).select(F.col("row").alias("tree"), "path"))
    out = proven(low, top)
    return out.join(F.broadcast(ends) if subroots.count() <= BROADCAST_RANGES else ends, "tree").select("row.*", "subroot", "root", "path")


def verified(docs: DataFrame) -> DataFrame:
    """The manifest as hex text, each row's proof as a digest, and what folding it from the tampered or own leaf gives."""
    out = manifest(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    flat = F.concat_ws("", F.transform("path", lambda x: F.concat(hex_text(x.before), hex_text(x.after))))
    return out.select("doc_id", hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"), F.sha2(flat, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == hex_text(F.col("root"))).alias("verified"))
