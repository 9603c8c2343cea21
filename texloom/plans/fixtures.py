"""Inputs of the registered queries, derived from the tables: a surface of events, blocks of hashes, headers of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    """x, y, r, g, b, a (8 bits): one surface."""
    ev = table(spark, sf_dir, "events").select("event_id", "value", "user_id", "event_type")
    return ev.select(
        (F.col("event_id") % width).alias("x"), F.floor(F.col("event_id") / width).cast("long").alias("y"),
        F.floor(F.least(F.col("value") / 500, F.lit(1.0)) * 255 + 0.5).cast("long").alias("r"), ((F.col("event_id") * 37) % 256).alias("g"),
        (F.col("user_id") % 256).alias("b"), F.when(F.col("event_type") == "error", 0).otherwise(255).cast("long").alias("a"),
    )


PIXELS_SQL = """px AS (SELECT event_id % 100 AS x, event_id // 100 AS y, CAST(floor(least(value / 500, 1.0) * 255 + 0.5) AS BIGINT) AS r, (event_id * 37) % 256 AS g,
  user_id % 256 AS b, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 255 END AS BIGINT) AS a FROM events)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, block: 16 bytes (an array of long) from the MD5 of the id and k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    digest = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).cast("binary"))
    hexed = docs.select("doc_id", F.col("k").cast("long").alias("k"), digest.alias("digest"))
    return hexed.select("doc_id", "k", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.conv(F.substring(F.col("digest"), j * 2 + 1, F.lit(2)), 16, 10).cast("long")).alias("block"))


BLOCKS_SQL = """dg AS (SELECT doc_id, k, md5(concat(doc_id, '-', k)) AS digest FROM documents, (SELECT unnest(range(4)) AS k)),
bl AS (SELECT doc_id, k, list_transform(range(16), lambda j: CAST(concat('0x', substr(digest, CAST(2 * j + 1 AS INTEGER), 2)) AS BIGINT)) AS block FROM dg)"""


def block_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, data: the same 16 bytes as binary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    digest = F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).cast("binary"))
    return docs.select("doc_id", F.col("k").cast("long").alias("k"), F.unhex(digest).alias("data"))


def strips(spark: SparkSession, sf_dir: str, sizes: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Each block as a strip of every format: format, data, width, rows; `sizes` has width, rows and bytes of each. One scan."""
    each = F.array(*(F.struct(F.lit(name).alias("format"), F.lit(w).alias("width"), F.lit(h).alias("rows"), F.lit(n).alias("n")) for name, (w, h, n) in sizes.items()))
    spread = block_bytes(spark, sf_dir).withColumn("s", F.explode(each))
    return spread.select("doc_id", "k", "s.format", F.substring(F.col("data"), F.lit(1), F.col("s.n")).alias("data"), "s.width", "s.rows")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, i, r, g, b, a: each embedding as a block of 16 pixels of 8 bits."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.sequence(F.lit(0), F.lit(15))).alias("i", "_n"), "embedding")
    value = lambda c: F.floor(F.least(F.greatest((F.get("embedding", F.col("i") * 4 + c).cast("double") + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("long")
    return emb.select("vec_id", F.col("i").cast("long").alias("i"), *(value(c).alias(n) for c, n in enumerate("rgba")))


VECTORS_SQL = """vx AS (SELECT vec_id, i, embedding FROM embeddings, (SELECT unnest(range(16)) AS i)),
vp AS (SELECT vec_id, i, CAST(floor(least(greatest((CAST(embedding[i * 4 + 1] AS DOUBLE) + 1) / 2, 0), 1) * 255 + 0.5) AS BIGINT) AS r,
  CAST(floor(least(greatest((CAST(embedding[i * 4 + 2] AS DOUBLE) + 1) / 2, 0), 1) * 255 + 0.5) AS BIGINT) AS g,
  CAST(floor(least(greatest((CAST(embedding[i * 4 + 3] AS DOUBLE) + 1) / 2, 0), 1) * 255 + 0.5) AS BIGINT) AS b,
  CAST(floor(least(greatest((CAST(embedding[i * 4 + 4] AS DOUBLE) + 1) / 2, 0), 1) * 255 + 0.5) AS BIGINT) AS a FROM vx)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), "o_custkey")
    key, cust = F.col("file_id"), F.col("o_custkey")
    return o.select(
        "file_id", (key % 5).alias("shape"), (1 + key % 4096).alias("width"), (1 + cust % 4096).alias("height"), (1 + key % 8).alias("depth"), (1 + cust % 12).alias("mips"), (key % 4).alias("array_size"), (key % 73).alias("format_no"), (cust % 64).alias("face_mask")
    )


ORDERS_SQL = """od AS (SELECT o_orderkey AS file_id, o_orderkey % 5 AS shape, 1 + o_orderkey % 4096 AS width, 1 + o_custkey % 4096 AS height, 1 + o_orderkey % 8 AS depth,
  1 + o_custkey % 12 AS mips, o_orderkey % 4 AS array_size, o_orderkey % 73 AS format_no, o_custkey % 64 AS face_mask FROM orders)"""
