"""Registered queries of header writing, repair by the file's length, and extended headers as legacy ones, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import formats as dims
from texloom.operators import layout
from texloom.plans import fixtures as X
from texloom.plans import texture_queries as T
from texloom.plans.texture_queries import query
from texloom.sources import container


# The format that a header itself says: its code's, that of its FourCC, or R8G8B8A8_UNORM for formats without a code. Every
# 37th header is so large that no size fits 32 bits.
_SAID_SQL = f"""sd AS (SELECT od.file_id, shape, mips, face_mask, array_size, depth, n.kind, n.bytes, n.dxgi, CAST(width * big AS BIGINT) AS w, CAST(height * big AS BIGINT) AS h,
  CASE n.kind WHEN 'fixed' THEN (width * big)::HUGEINT * n.bytes ELSE {T._BYTES.format(w="(width * big)::HUGEINT", h="(height * big)::HUGEINT").replace("kind", "n.kind").replace("* bytes", "* n.bytes").replace("block_", "n.block_").replace("plane", "n.plane").replace("sub_", "n.sub_")} END AS size
  FROM (SELECT *, CASE WHEN file_id % 37 = 0 THEN 262144 ELSE 1 END AS big FROM od) od JOIN fm f USING (format_no)
  JOIN (SELECT *, row_number() OVER (PARTITION BY format ORDER BY format_no) AS no FROM fm) n ON n.no = 1 AND n.format = CASE WHEN shape = 4 THEN 'BC3_UNORM' WHEN f.dxgi IS NULL THEN 'R8G8B8A8_UNORM' ELSE f.format END)"""


@query(
    """SELECT file_id, w AS width, h AS height, CAST(4103 + 131072 + CASE WHEN size >= 4294967296 THEN 0 WHEN kind = 'fixed' THEN 8 ELSE 524288 END + CASE WHEN shape = 2 THEN 8388608 ELSE 0 END AS BIGINT) AS flags, CAST(CASE WHEN size < 4294967296 THEN size ELSE 0 END AS BIGINT) AS pitch,
CAST(CASE WHEN shape = 2 THEN depth ELSE 1 END AS BIGINT) AS depth, CAST(mips AS BIGINT) AS mipmap_count, CAST(4096 + CASE WHEN mips > 1 THEN 4194312 ELSE 0 END AS BIGINT) AS caps, CASE WHEN shape <> 4 THEN CAST(dxgi AS BIGINT) END AS dxgi,
CAST(CASE shape WHEN 4 THEN 512 + CASE WHEN face_mask = 0 THEN 1 ELSE face_mask END * 1024 WHEN 2 THEN 2097152 WHEN 3 THEN 65024 ELSE 0 END AS BIGINT) AS caps2, CAST(CASE WHEN shape = 4 THEN 894720068 ELSE 808540228 END AS BIGINT) AS four_cc,
CAST(CASE WHEN shape <> 4 THEN CASE WHEN shape = 3 THEN 4 ELSE 0 END END AS BIGINT) AS misc, CAST(CASE WHEN shape = 2 THEN 1 WHEN shape <> 4 THEN array_size END AS BIGINT) AS array_size FROM sd""",
    X.ORDERS_SQL, T._FORMATS_SQL, _SAID_SQL,
)
def q_header_write(spark, sf_dir):
    """Raw words of headers of every shape and format, written as bytes and read again; sizes follow the header's own format."""
    none, legacy, big = F.lit(None).cast("long"), F.col("version") == "dx9", F.when(F.col("file_id") % 37 == 0, 262144).otherwise(1)
    codes = dims.formats(spark).select("format", "dxgi")
    headers = T._synthetic_headers(spark, sf_dir).drop(*layout.INFO).join(F.broadcast(codes), "format").drop("format")  # a row a format
    headers = headers.withColumns({"dxgi": F.when(~legacy, F.coalesce("dxgi", F.lit(28))).cast("int"), "alpha_mode": F.lit(1), "four_cc": F.when(legacy, dims.fourcc_number("DXT5")).cast("long"), "width": F.col("width") * big, "height": F.col("height") * big} | {c: none for c in ("pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask")})
    words = container.to_words(container.with_format(headers))
    back = container.raw_words(words.select("file_id", container.write_raw(words).alias("content")))
    return back.select("file_id", *(F.col(c).cast("long").alias(c) for c in ("width", "height", "flags", "pitch", "depth", "mipmap_count", "caps", "dxgi", "caps2", "four_cc", "misc", "array_size")))


_BAD = "file_id % 6"
_TRUE_MIPS, _TRUE_ARRAY = f"CASE WHEN {_BAD} = 2 THEN 1 ELSE mips END", f"CASE WHEN {_BAD} = 1 OR shape IN (2, 4) THEN 1 ELSE greatest(array_size, 1) END"


@query(
    f"""SELECT file_id, CAST(CASE WHEN {_BAD} = 5 THEN {_TRUE_MIPS} + 1 ELSE {_TRUE_MIPS} END AS BIGINT) AS mipmap_count, CAST(CASE WHEN shape <> 4 THEN {_TRUE_ARRAY} END AS BIGINT) AS array_size FROM od""",
    X.ORDERS_SQL,
)
def q_header_repair(spark, sf_dir):
    """Headers with one fault each, mended by the length of the file.

    By file_id % 6: none; array size 0; three mip levels too many; one too many; one too few; a length that nothing gives."""
    bad, legacy = F.col("file_id") % 6, F.col("version") == "dx9"
    true = T._synthetic_headers(spark, sf_dir).withColumns({"mipmap_count": F.when(bad == 2, 1).otherwise(F.col("mipmap_count")).cast("long"), "array_size": F.when(~legacy, F.when(bad == 1, 1).otherwise(F.greatest("array_size", F.lit(1)))).cast("long")})
    length = F.col("data_len").cast("long") + F.when(legacy, 128).otherwise(148) + F.when(bad == 5, 1).otherwise(0)
    sized = layout.with_layout(true).select(*true.columns, length.alias("file_length"))
    mips = F.col("mipmap_count") + F.when(bad == 2, 3).when(bad.isin(3, 5), 1).when((bad == 4) & (F.col("mipmap_count") > 1), -1).otherwise(0)
    marred = sized.withColumns({"mipmap_count": mips.cast("long"), "array_size": F.when((bad == 1) & ~legacy & (F.col("shape") != 2), 0).otherwise(F.col("array_size")).cast("long")})
    mended = container.repair(marred, F.col("file_length"))
    return mended.select("file_id", F.col("mipmap_count").cast("long").alias("mipmap_count"), F.col("array_size").cast("long").alias("array_size"))


_CODES = sorted({code: name for name, code in dims.DXGI_CODE.items()}.items())
_CODES_SQL = "dc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {code}, '{name}')" for i, (code, name) in enumerate(_CODES)) + ") t(no, code, name))"
# The FourCC that a format is written with.
_WRITTEN = {
    "BC1_UNORM": "DXT1", "BC2_UNORM": "DXT3", "BC3_UNORM": "DXT5", "BC4_UNORM": "BC4U", "BC4_SNORM": "BC4S", "BC5_UNORM": "BC5U", "BC5_SNORM": "BC5S", "R8G8_B8G8_UNORM": "RGBG", "G8R8_G8B8_UNORM": "GRGB", "YUY2": "YUY2",
    "R16G16B16A16_UNORM": 36, "R16G16B16A16_SNORM": 110, "R16_FLOAT": 111, "R16G16_FLOAT": 112, "R16G16B16A16_FLOAT": 113, "R32_FLOAT": 114, "R32G32_FLOAT": 115, "R32G32B32A32_FLOAT": 116,
}
_number = lambda c: c if isinstance(c, int) else int.from_bytes(c.encode(), "little")
_WRITTEN_SQL = "wr AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', {_number(c)})" for name, c in _WRITTEN.items()) + ") t(linear, four_cc))"
_first_mask = {r[7]: r[1:7] for r in reversed(dims.mask_rows()) if r[7] is not None}
_MASKS_SQL = "mk AS (SELECT * FROM (VALUES " + ", ".join(f"({d}, {m[1] or 0}, {m[2] or 0})" for d, m in _first_mask.items()) + ") t(mask_code, bits, r_mask))"
_HEADS_SQL = f"hd AS (SELECT o_orderkey AS file_id, code, replace(name, '_UNORM_SRGB', '_UNORM') AS linear, o_custkey % 5 AS alpha, CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 1 END AS array_size, o_orderkey % 3 = 0 AS cube, 2 + o_custkey % 3 AS dim FROM orders JOIN dc ON dc.no = o_orderkey % {len(_CODES)})"


@query(
    f"""SELECT file_id, ok AS convertible, CAST(CASE WHEN ok THEN cc END AS BIGINT) AS four_cc, CAST(CASE WHEN ok AND cc IS NULL THEN bits END AS BIGINT) AS bits, CAST(CASE WHEN ok AND cc IS NULL THEN r_mask END AS BIGINT) AS r_mask,
CAST(CASE WHEN ok THEN (CASE WHEN cube THEN 65024 ELSE 0 END) + (CASE WHEN dim = 4 THEN 2097152 ELSE 0 END) END AS BIGINT) AS caps2
FROM (SELECT *, array_size = 1 AND NOT (cube AND dim <> 3) AND (cc IS NOT NULL OR bits IS NOT NULL) AS ok FROM (SELECT hd.*, bits, r_mask, CASE WHEN alpha = 2 AND hd.linear = 'BC2_UNORM' THEN {_number("DXT2")} WHEN alpha = 2 AND hd.linear = 'BC3_UNORM' THEN {_number("DXT4")} ELSE four_cc END AS cc
  FROM hd LEFT JOIN wr ON wr.linear = hd.linear LEFT JOIN dc d2 ON d2.name = hd.linear LEFT JOIN mk ON mk.mask_code = d2.code))""",
    _CODES_SQL, _WRITTEN_SQL, _MASKS_SQL, _HEADS_SQL,
)
def q_dx10_dx9(spark, sf_dir):
    """Extended headers of every code as legacy ones: with alpha modes, arrays, cubes and all dimensions."""
    codes = F.array(*(F.lit(code) for code, _ in _CODES))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    headers = X.table(spark, sf_dir, "orders").select(
        key.alias("file_id"), F.get(codes, (key % len(_CODES)).cast("int")).cast("int").alias("dxgi"), (cust % 5).cast("int").alias("alpha_mode"), F.when(cust % 7 == 0, 2).otherwise(1).cast("long").alias("array_size"),
        F.when(key % 3 == 0, container.MISC_CUBE).otherwise(0).cast("long").alias("misc"), (2 + cust % 3).cast("int").alias("resource_dim"),
    )
    out = container.to_dx9(headers)
    return out.select("file_id", "convertible", "four_cc", F.col("mask.bits").cast("long").alias("bits"), F.col("mask.r_mask").cast("long").alias("r_mask"), "caps2")


# -- cursor ------------------------------------------------------------------------------------------------------------

_SCAN_SQL = f"""ls AS (SELECT file_id, shape, mips, m, e, s, w, h, {T._BYTES.format(w="w", h="h")} AS len FROM (
  SELECT od.*, fm.* EXCLUDE (format_no), m, e, s, greatest(width >> m, 1) AS w, CASE WHEN shape = 1 THEN 1 ELSE greatest(height >> m, 1) END AS h
  FROM od JOIN fm USING (format_no), unnest(range(mips)) a(m), unnest(range(CASE shape WHEN 2 THEN 1 WHEN 3 THEN array_size * 6 WHEN 4 THEN bit_count(CASE WHEN face_mask = 0 THEN 1 ELSE face_mask END) ELSE array_size END)) b(e), unnest(range(CASE WHEN shape = 2 THEN greatest(depth >> m, 1) ELSE 1 END)) c(s))),
sc AS (SELECT *, row_number() OVER f - 1 AS ordinal, count(*) OVER (PARTITION BY file_id) AS n, sum(len) OVER f - len AS elapsed, sum(len) OVER (PARTITION BY file_id, e ORDER BY m, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  max(0) OVER f AS z FROM ls WINDOW f AS (PARTITION BY file_id ORDER BY e, m, s ROWS UNBOUNDED PRECEDING)),
nx AS (SELECT *, lag(ordinal) OVER f AS previous, lead(ordinal) OVER f AS next, max(ordinal) OVER (PARTITION BY file_id, e) + 1 AS beyond FROM sc WINDOW f AS (PARTITION BY file_id ORDER BY ordinal))"""


@query(
    """SELECT file_id, e AS array_index, CAST(m AS INTEGER) AS mip_level, CAST(s AS BIGINT) AS depth_slice, ordinal, n AS count, CAST(elapsed AS BIGINT) AS elapsed, previous, next,
CASE WHEN shape = 2 AND s > 0 THEN 'CannotSkipMipmapsInVolume' END AS skip_error, CAST(CASE WHEN shape = 2 AND s > 0 THEN NULL WHEN m = 0 THEN 0 ELSE rest END AS BIGINT) AS skip_bytes, CASE WHEN shape = 2 AND s > 0 THEN NULL WHEN m = 0 THEN ordinal ELSE beyond END AS skip_to FROM nx""",
    X.ORDERS_SQL, T._FORMATS_SQL, _SCAN_SQL,
)
def q_surface_cursor(spark, sf_dir):
    """Every place of a cursor over the surfaces of textures, arrays, volumes and (partial) cube maps, and where it moves."""
    rows = layout.cursor(layout.with_layout(T._synthetic_headers(spark, sf_dir)))
    return rows.select("file_id", "array_index", "mip_level", "depth_slice", "ordinal", "count", "elapsed", "previous", "next", "skip_error", "skip_bytes", "skip_to")


_PICK = "m = file_id % 5 AND e = file_id % 3 AND s = file_id % 2"


@query(f"SELECT file_id, w AS width, h AS height, CAST(elapsed AS BIGINT) AS \"offset\", CAST(len AS BIGINT) AS len FROM sc WHERE {_PICK}", X.ORDERS_SQL, T._FORMATS_SQL, _SCAN_SQL)
def q_surface_get(spark, sf_dir):
    """One surface of each file by element, level and slice; files without it have no row."""
    rows = layout.surfaces(layout.with_layout(T._synthetic_headers(spark, sf_dir)))
    key = F.col("file_id")
    found = rows.filter((F.col("mip_level") == key % 5) & (F.col("array_index") == key % 3) & (F.col("depth_slice") == key % 2))
    return found.select("file_id", "width", "height", F.col("offset").cast("long").alias("offset"), F.col("len").cast("long").alias("len"))
