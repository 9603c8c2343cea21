"""Registered queries over files: written through the sink, opened by the source, surfaces and rectangles read by byte ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.operators import layout
from texloom.plans import fixtures as X
from texloom.plans.texture_queries import query
from texloom.sources import container, files

WIDTH = 64


def _folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one; a local one only where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='texloom-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, rows and padded of each document: its text as lines of 64 grey pixels, the last one filled with blanks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = F.greatest(F.ceil(F.octet_length(text) / WIDTH), F.lit(1)).cast("long")
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), rows.alias("rows"), text.alias("text"))
    blanks = F.expr(f"repeat(' ', cast(rows * {WIDTH} - octet_length(text) as int))")
    return docs.select("file_id", "rows", F.concat("text", blanks).cast("binary").alias("padded"))


def _headers(images: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Headers of grey 8-bit textures with two mip levels; every eleventh an array of two. `keep` names columns that stay."""
    none, long = F.lit(None).cast("long"), lambda v: F.lit(v).cast("long")
    two = F.when(F.col("file_id") % 11 == 0, 2).otherwise(1).cast("long")
    rows = images.select(
        "file_id", F.concat(F.lit("d"), F.col("file_id") % 7, F.lit("/"), F.col("file_id"), F.lit(".dds")).alias("file"), F.lit("dx10").alias("version"), long(WIDTH).alias("width"), F.col("rows").alias("height"), none.alias("depth"), long(2).alias("mipmap_count"),
        *(none.alias(c) for c in ("four_cc", "pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask", "caps2")), F.lit(61).alias("dxgi"), F.lit(3).alias("resource_dim"), long(0).alias("misc"), two.alias("array_size"), F.lit(0).alias("alpha_mode"), *keep,
    )
    return layout.with_layout(container.with_format(rows))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Write a file for each document; the second mip level and the second element hold the first bytes again."""
    images, path = _images(spark, sf_dir), _folder(spark)
    _headers(images).write.parquet(f"{path}-headers")  # used twice below
    headers = spark.read.parquet(f"{path}-headers")
    # the texts stay in their rows: a text is shuffled to meet its places and to be written, no more
    data = layout.surfaces(_headers(images, ("padded",)), ["file", "padded"]).select("file", "array_index", "mip_level", "depth_slice", F.substring(F.col("padded"), F.lit(1), F.col("len").cast("int")).alias("data"))
    files.write(files.checked(headers, data), path)
    return path


_IMAGES_SQL = """im AS (SELECT doc_id, greatest((strlen(coalesce(text, '')) + 63) // 64, 1) AS rows, hex(encode(concat(coalesce(text, ''), repeat(' ', CAST(greatest((strlen(coalesce(text, '')) + 63) // 64, 1) * 64 - strlen(coalesce(text, '')) AS INTEGER))))) AS bytes FROM documents)"""


@query(
    """SELECT doc_id, CAST(e AS BIGINT) AS array_index, CAST(m AS INTEGER) AS mip_level, CAST(64 >> m AS BIGINT) AS width, CAST(greatest(rows >> m, 1) AS BIGINT) AS height, CAST(e * (64 * rows + 32 * greatest(rows >> 1, 1)) + m * 64 * rows AS BIGINT) AS elapsed,
md5(unhex(substr(bytes, 1, 2 * (64 >> m) * greatest(rows >> m, 1)))) AS digest FROM im, (SELECT unnest(range(2)) AS e), (SELECT unnest(range(2)) AS m) WHERE e = 0 OR doc_id % 11 = 0""",
    _IMAGES_SQL,
)
def q_file_roundtrip(spark, sf_dir):
    """Every document as a file: written, opened by its header, and every surface read by its byte range."""
    rows = files.with_bytes(files.surfaces(files.opened(spark, _stored(spark, sf_dir))))
    doc = F.regexp_extract("path", "([0-9]+)[.]dds$", 1).cast("long").alias("doc_id")
    return rows.select(doc, "array_index", "mip_level", "width", "height", "elapsed", F.md5("data").alias("digest"))


@query(
    """SELECT doc_id, CAST(count(*) AS BIGINT) AS reads, CAST(count(*) * w AS BIGINT) AS bytes_read, md5(unhex(string_agg(substr(bytes, 2 * (64 * y + x) + 1, 2 * w), '' ORDER BY y))) AS digest FROM (
  SELECT *, doc_id % 50 AS x, 1 + doc_id % 14 AS w, unnest(range(rows // 3, rows // 3 + greatest(rows // 2, 1))) AS y FROM im) GROUP BY doc_id, w""",
    _IMAGES_SQL,
)
def q_file_region(spark, sf_dir):
    """A rectangle of each document's image: only its lines' bytes are read."""
    main = files.surfaces(files.opened(spark, _stored(spark, sf_dir))).filter("mip_level = 0 and array_index = 0")
    main = main.withColumn("doc_id", F.regexp_extract("path", "([0-9]+)[.]dds$", 1).cast("long"))
    third, half = F.floor(F.col("height") / 3), F.greatest(F.floor(F.col("height") / 2), F.lit(1))
    lines = files.with_bytes(files.region(main, F.col("doc_id") % 50, third, 1 + F.col("doc_id") % 14, half))
    gathered = lines.groupBy("doc_id").agg(F.count("*").alias("reads"), F.sum("size").alias("bytes_read"), F.sort_array(F.collect_list(F.struct("first_y", "data"))).alias("lines"))
    return gathered.select("doc_id", "reads", "bytes_read", F.md5(F.aggregate("lines", F.lit(b""), lambda a, x: F.concat(a, x.data))).alias("digest"))
