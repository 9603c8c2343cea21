"""Registered queries of the texture operators, with the same computation as independent DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from texloom.functions import bc_tables
from texloom.functions import formats as dims
from texloom.functions import scalar as S
from texloom.functions.local import local_table
from texloom.operators import blocks as B
from texloom.operators import decode, layout, packed, raster
from texloom.plans import fixtures as X
from texloom.sources import container

NATIVE = {f[0]: (f[1].lower(), f[2].lower()) for f in dims.FORMATS}


def named_bits(name: str) -> list[tuple[str, int, int]]:
    """(channel, bits, position) by a format's name, from the lowest bit."""
    found = [(c, int(bits)) for c, bits in re.findall(r"([RGBAX])(\d+)", name.replace("_XR_BIAS_", ""))]
    return [(c, bits, sum(b for _, b in found[:i])) for i, (c, bits) in enumerate(found)]


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *parts: str):
    """Register the function under its name, with the SQL that must give its rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
        return f

    return put


# -- scalars -----------------------------------------------------------------------------------------------------------


@query(
    """, q AS (SELECT *, (r * 31 * 2 + 255) // 510 AS r5, (g * 63 * 2 + 255) // 510 AS g6, (b * 31 * 2 + 255) // 510 AS b5 FROM px),
u AS (SELECT *, (r5 * 510 + 31) // 62 AS r2, (g6 * 510 + 63) // 126 AS g2, (b5 * 510 + 31) // 62 AS b2 FROM q)
SELECT CAST(count(*) AS BIGINT) AS n_pixels, CAST(sum((r - r2) * (r - r2)) AS BIGINT) AS sse_r, CAST(sum((g - g2) * (g - g2)) AS BIGINT) AS sse_g, CAST(sum((b - b2) * (b - b2)) AS BIGINT) AS sse_b FROM u""",
    X.PIXELS_SQL,
)
def q_b5g6r5_roundtrip_mse(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    back = raster.unpack_565(px.select("r", "g", "b", raster.pack_565(F.col("r"), F.col("g"), F.col("b")).alias("w")))
    err = lambda c: F.sum((F.col(c) - F.col(c + "2")) * (F.col(c) - F.col(c + "2"))).cast("long").alias("sse_" + c)
    return back.agg(F.count("*").cast("long").alias("n_pixels"), err("r"), err("g"), err("b"))


@query(
    """SELECT event_id, CAST(floor(least(value / 500, 1.0) + 0.5) AS BIGINT) AS n1, CAST(floor(least(value / 500, 1.0) * 15 + 0.5) AS BIGINT) AS n4, CAST(floor(least(value / 500, 1.0) * 31 + 0.5) AS BIGINT) AS n5,
CAST(floor(least(value / 500, 1.0) * 63 + 0.5) AS BIGINT) AS n6, CAST(floor(least(value / 500, 1.0) * 255 + 0.5) AS BIGINT) AS n8, CAST(floor(least(value / 500, 1.0) * 1023 + 0.5) AS BIGINT) AS n10,
CAST(floor(least(value / 500, 1.0) * 65535 + 0.5) AS BIGINT) AS n16 FROM events"""
)
def q_unorm_quantize(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    return ev.select("event_id", *(S.quantise(F.col("value") / 500, w).alias(f"n{w}") for w in (1, 4, 5, 6, 8, 10, 16)))


@query(
    """SELECT event_id, """
    + ", ".join(f"((event_id % {1 << s}) * {2 * ((1 << t) - 1)} + {(1 << s) - 1}) // {2 * ((1 << s) - 1)} AS n{s}_{t}" for s, t in ((1, 8), (1, 16), (2, 8), (2, 16), (4, 8), (4, 16), (5, 8), (5, 16), (6, 8), (6, 16), (8, 16), (10, 8), (10, 16), (16, 8)))
    + " FROM events"
)
def q_unorm_expand(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events")
    widths = ((1, 8), (1, 16), (2, 8), (2, 16), (4, 8), (4, 16), (5, 8), (5, 16), (6, 8), (6, 16), (8, 16), (10, 8), (10, 16), (16, 8))
    return ev.select("event_id", *(S.unorm(F.col("event_id") % (1 << s), s, t).alias(f"n{s}_{t}") for s, t in widths))


@query(
    """, s AS (SELECT vec_id, i, r, greatest(((r + 128) % 256) - 1, 0) AS c8, CAST(floor(r / 255.0 * 254 + 0.5) AS BIGINT) + 1 AS up FROM vp)
SELECT vec_id, i, (c8 * 510 + 254) // 508 AS from_s8, (c8 * 131070 + 254) // 508 AS from_s8_16, (up + 128) % 256 AS to_s8 FROM s""",
    X.VECTORS_SQL,
)
def q_snorm_roundtrip(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    return v.select("vec_id", "i", S.snorm8(F.col("r"), 8).alias("from_s8"), S.snorm8(F.col("r"), 16).alias("from_s8_16"), S.to_snorm(F.col("r") / 255.0, 8).alias("to_s8"))


@query(
    """SELECT x, y, ((b * 62 + 255) // 510) | (((g * 126 + 255) // 510) << 5) | (((r * 62 + 255) // 510) << 11) AS b5g6r5,
((b * 62 + 255) // 510) | (((g * 62 + 255) // 510) << 5) | (((r * 62 + 255) // 510) << 10) | (((a * 2 + 255) // 510) << 15) AS b5g5r5a1,
((b * 30 + 255) // 510) | (((g * 30 + 255) // 510) << 4) | (((r * 30 + 255) // 510) << 8) | (((a * 30 + 255) // 510) << 12) AS b4g4r4a4,
((r * 2046 + 255) // 510) | (((g * 2046 + 255) // 510) << 10) | (((b * 2046 + 255) // 510) << 20) | (((a * 6 + 255) // 510) << 30) AS r10g10b10a2 FROM px""",
    X.PIXELS_SQL,
)
def q_pack(spark, sf_dir):
    c = {n: F.col(n) for n in "rgba"}
    return X.pixels(spark, sf_dir).select("x", "y", *(raster.pack(c, spec).alias(n) for n, spec in raster.PACKED.items()))


@query(
    """SELECT x, y, r AS rgb_to_gray, a AS rgba_to_alpha, CAST(255 AS BIGINT) AS rgb_to_alpha, CAST(0 AS BIGINT) AS alpha_to_gray, r AS gray_to_rgba_g, CAST(255 AS BIGINT) AS gray_to_rgba_a, CAST(0 AS BIGINT) AS alpha_to_rgb_b, a AS alpha_to_rgba_a FROM px""",
    X.PIXELS_SQL,
)
def q_channel_matrix(spark, sf_dir):
    one, c = F.lit(255).cast("long"), {n: F.col(n) for n in "rgba"}
    v = lambda s, t, i: S.convert(s, t, c, one)[i]
    return X.pixels(spark, sf_dir).select(
        "x", "y", v("rgb", "grayscale", 0).alias("rgb_to_gray"), v("rgba", "alpha", 0).alias("rgba_to_alpha"), v("rgb", "alpha", 0).alias("rgb_to_alpha"), v("alpha", "grayscale", 0).alias("alpha_to_gray"),
        v("grayscale", "rgba", 1).alias("gray_to_rgba_g"), v("grayscale", "rgba", 3).alias("gray_to_rgba_a"), v("alpha", "rgb", 2).alias("alpha_to_rgb_b"), v("alpha", "rgba", 3).alias("alpha_to_rgba_a"),
    )


_CLIP = "CAST(least(greatest(floor({} + 0.5), 0), 255) AS BIGINT)"
_TO_YUV = f"""yv AS (SELECT x, y, {_CLIP.format("r * 0.256788235294118::DOUBLE + g * 0.504129411764706::DOUBLE + b * 0.0979058823529412::DOUBLE + 16")} AS yy,
{_CLIP.format("r * -0.148223::DOUBLE + g * -0.290993::DOUBLE + b * 0.439216::DOUBLE + 128")} AS u, {_CLIP.format("r * 0.439216::DOUBLE + g * -0.367788::DOUBLE + b * -0.0714274::DOUBLE + 128")} AS v FROM px)"""


def _to_rgb(y, u, v):
    c = f"({y} - 16) * 1.164383561643836::DOUBLE"
    return [_CLIP.format(f"({c} + ({v} - 128) * 1.596026785714286::DOUBLE)"), _CLIP.format(f"({c} + ({u} - 128) * -0.391762290094914::DOUBLE + ({v} - 128) * -0.812967647237771::DOUBLE)"), _CLIP.format(f"({c} + ({u} - 128) * 2.017232142857142::DOUBLE)")]


@query("SELECT x, y, yy, u, v, {} AS r2, {} AS g2, {} AS b2 FROM yv".format(*_to_rgb("yy", "u", "v")), X.PIXELS_SQL, _TO_YUV)
def q_yuv_roundtrip(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    y, u, v = S.rgb_to_yuv8(F.col("r"), F.col("g"), F.col("b"))
    yuv = px.select("x", "y", y.alias("yy"), u.alias("u"), v.alias("v"))
    r, g, b = S.yuv8_to_rgb(F.col("yy"), F.col("u"), F.col("v"))
    return yuv.select("x", "y", "yy", "u", "v", r.alias("r2"), g.alias("g2"), b.alias("b2"))


@query(
    """, c AS (SELECT x // 2 AS cx, y // 2 AS cy, CAST(floor(avg(u)) AS BIGINT) AS u, CAST(floor(avg(v)) AS BIGINT) AS v FROM yv GROUP BY ALL)
SELECT yv.x, yv.y, {} AS r2, {} AS g2, {} AS b2 FROM yv JOIN c ON c.cx = yv.x // 2 AND c.cy = yv.y // 2""".format(*_to_rgb("yv.yy", "c.u", "c.v")),
    X.PIXELS_SQL, _TO_YUV,
)
def q_chroma_420(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    y, u, v = S.rgb_to_yuv8(F.col("r"), F.col("g"), F.col("b"))
    yuv = px.select("x", "y", y.alias("yy"), u.alias("u"), v.alias("v"))
    return raster.upsampled_420(yuv, raster.chroma_420(yuv))


@query(
    """WITH h AS (SELECT event_id, event_id % 65536 AS w FROM events), p AS (SELECT event_id, w >> 15 AS s, (w >> 10) & 31 AS e, w & 1023 AS m FROM h)
SELECT event_id, CASE WHEN e < 31 THEN CAST(round((CASE WHEN s = 1 THEN -1 ELSE 1 END) * (CASE WHEN e = 0 THEN m * pow(2.0, -24) ELSE (m + 1024) * pow(2.0, e - 25) END) * 16777216) AS BIGINT) END AS scaled,
CASE WHEN e = 31 THEN CASE WHEN m > 0 THEN 'nan' WHEN s = 1 THEN '-inf' ELSE 'inf' END END AS special FROM p"""
)
def q_half_decode(spark, sf_dir):
    """Halves of all bit patterns: finite ones scaled to whole numbers, the others by name."""
    ev = X.table(spark, sf_dir, "events").select("event_id", S.half_to_double((F.col("event_id") % 65536).cast("long")).alias("v"))
    return ev.select("event_id", F.when(_special("v").isNull(), F.round(F.col("v") * 16777216.0)).cast("long").alias("scaled"), _special("v").alias("special"))


def _special(name: str):
    """What a number is that is not finite, else null."""
    v, inf = F.col(name), float("inf")
    return F.when(F.isnan(v), "nan").when(v == inf, "inf").when(v == -inf, "-inf")


@query(
    """WITH p AS (SELECT event_id, event_id % 2048 AS f11, event_id % 1024 AS f10 FROM events)
SELECT event_id, CASE WHEN f11 < 1984 THEN CAST((CASE WHEN f11 >> 6 = 0 THEN (f11 & 63) * pow(2.0, -20) ELSE ((f11 & 63) + 64) * pow(2.0, (f11 >> 6) - 21) END) * 1048576 AS BIGINT) END AS v11,
CASE WHEN f10 < 992 THEN CAST((CASE WHEN f10 >> 5 = 0 THEN (f10 & 31) * pow(2.0, -19) ELSE ((f10 & 31) + 32) * pow(2.0, (f10 >> 5) - 20) END) * 524288 AS BIGINT) END AS v10,
CASE WHEN f11 = 1984 THEN 'inf' WHEN f11 > 1984 THEN 'nan' END AS special11, CASE WHEN f10 = 992 THEN 'inf' WHEN f10 > 992 THEN 'nan' END AS special10 FROM p"""
)
def q_small_floats(spark, sf_dir):
    """Unsigned floats of 11 and 10 bits: finite ones scaled to whole numbers, the others by name."""
    ev = X.table(spark, sf_dir, "events").select("event_id", S.small_float((F.col("event_id") % 2048).cast("long"), 6).alias("a"), S.small_float((F.col("event_id") % 1024).cast("long"), 5).alias("b"))
    whole = lambda c, scale: F.when(_special(c).isNull(), F.col(c) * scale).cast("long")
    return ev.select("event_id", whole("a", 1048576.0).alias("v11"), whole("b", 524288.0).alias("v10"), _special("a").alias("special11"), _special("b").alias("special10"))


@query(
    """WITH p AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS w FROM events)
SELECT event_id, CAST((w & 511) * pow(2.0, w >> 27) AS BIGINT) AS r, CAST(((w >> 9) & 511) * pow(2.0, w >> 27) AS BIGINT) AS g, CAST(((w >> 18) & 511) * pow(2.0, w >> 27) AS BIGINT) AS b FROM p"""
)
def q_shared_exponent(spark, sf_dir):
    ev = X.table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("w"))
    return ev.select("event_id", *((c * float(1 << 24)).cast("long").alias(n) for c, n in zip(S.shared_exponent(F.col("w")), "rgb", strict=True)))


@query(
    """, l AS (SELECT x, y, r / 255.0::DOUBLE AS c FROM px) SELECT x, y, CAST(floor((CASE WHEN c <= 0.04045::DOUBLE THEN c / 12.92::DOUBLE ELSE pow((c + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) * 65535 + 0.5) AS BIGINT) AS linear16 FROM l""",
    X.PIXELS_SQL,
)
def q_srgb_linear(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("x", "y", F.floor(S.srgb_to_linear(F.col("r") / 255.0) * 65535 + 0.5).cast("long").alias("linear16"))


@query("SELECT x, y, (r * a * 2 + 255) // 510 AS pr, least(255, (r * 255) // (CASE WHEN a = 0 THEN 255 ELSE a END)) AS ur FROM px", X.PIXELS_SQL)
def q_premultiply(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("x", "y", S.premultiply(F.col("r"), F.col("a")).alias("pr"), S.unpremultiply(F.col("r"), F.col("a")).alias("ur"))


@query(
    "SELECT x, y, CAST(floor((sqrt(greatest(1 - (r / 255.0::DOUBLE * 2 - 1) * (r / 255.0::DOUBLE * 2 - 1) - (g / 255.0::DOUBLE * 2 - 1) * (g / 255.0::DOUBLE * 2 - 1), 0)) / 2 + 0.5) * 255 + 0.5) AS BIGINT) AS z FROM px",
    X.PIXELS_SQL,
)
def q_normal_z(spark, sf_dir):
    return X.pixels(spark, sf_dir).select("x", "y", S.normal_z(F.col("r"), F.col("g")).alias("z"))


# -- rasters -----------------------------------------------------------------------------------------------------------


@query("SELECT x - 20 AS x, y - 3 AS y, r, g, b, a FROM px WHERE x >= 20 AND x < 83 AND y >= 3 AND y < 38", X.PIXELS_SQL)
def q_crop(spark, sf_dir):
    return raster.crop(X.pixels(spark, sf_dir), 20, 3, 63, 35)


@query("SELECT y // 12 AS strip_id, min(y) AS y0, CAST(max(y) - min(y) + 1 AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS n_pixels, CAST(sum(r) AS BIGINT) AS sum_r FROM px GROUP BY 1", X.PIXELS_SQL)
def q_fragments(spark, sf_dir):
    strips = raster.fragments(X.pixels(spark, sf_dir), raster.strip_rows(X.WIDTH, 1300, 4))
    return strips.groupBy("strip_id").agg(F.min("y").alias("y0"), (F.max("y") - F.min("y") + 1).alias("rows"), F.count("*").cast("long").alias("n_pixels"), F.sum("r").cast("long").alias("sum_r"))


@query("SELECT y, md5(string_agg(lpad(upper(to_hex(r)), 2, '0'), '' ORDER BY x)) AS row_md5 FROM px GROUP BY y", X.PIXELS_SQL)
def q_gather(spark, sf_dir):
    rows = raster.gather(X.pixels(spark, sf_dir), ["y"], "x", F.unhex(F.lpad(F.hex("r"), 2, "0")))
    return rows.select("y", F.md5(F.hex("data").cast("binary")).alias("row_md5"))


@query(
    """SELECT x // 2 AS x, y // 2 AS y, (sum(r) * 2 + count(*)) // (2 * count(*)) AS r, (sum(g) * 2 + count(*)) // (2 * count(*)) AS g, (sum(b) * 2 + count(*)) // (2 * count(*)) AS b, (sum(a) * 2 + count(*)) // (2 * count(*)) AS a FROM px GROUP BY 1, 2""".replace("(sum", "CAST((sum").replace("count(*)) AS", "count(*)) AS BIGINT) AS"),
    X.PIXELS_SQL,
)
def q_mip_box(spark, sf_dir):
    return raster.mip_box(X.pixels(spark, sf_dir))


@query(
    """SELECT x // 2 AS x, y // 2 AS y, CAST(CASE WHEN sum(a) = 0 THEN 0 ELSE (sum(r * a) * 2 + sum(a)) // (2 * sum(a)) END AS BIGINT) AS r, CAST(CASE WHEN sum(a) = 0 THEN 0 ELSE (sum(g * a) * 2 + sum(a)) // (2 * sum(a)) END AS BIGINT) AS g,
CAST(CASE WHEN sum(a) = 0 THEN 0 ELSE (sum(b * a) * 2 + sum(a)) // (2 * sum(a)) END AS BIGINT) AS b, CAST((sum(a) * 2 + count(*)) // (2 * count(*)) AS BIGINT) AS a FROM px GROUP BY 1, 2""",
    X.PIXELS_SQL,
)
def q_mip_straight_alpha(spark, sf_dir):
    return raster.mip_box(X.pixels(spark, sf_dir), straight_alpha=True)


@query()
def q_fs_dither(spark, sf_dir):
    """Error diffusion of surfaces of 100 x 20 pixels, a recurrence within each; tests hold it against a plain loop."""
    px = X.pixels(spark, sf_dir).withColumn("surface", F.floor(F.col("y") / 20).cast("long"))
    return raster.floyd_steinberg(px.withColumn("y", F.col("y") % 20), "r", 1)


_BAYER = "[0,32,8,40,2,34,10,42,48,16,56,24,50,18,58,26,12,44,4,36,14,46,6,38,60,28,52,20,62,30,54,22,3,35,11,43,1,33,9,41,51,19,59,27,49,17,57,25,15,47,7,39,13,45,5,37,63,31,55,23,61,29,53,21]"


@query(f"SELECT y, x // 8 AS byte_x, CAST(sum(CASE WHEN r * 64 >= (64 - {_BAYER}[(y % 8) * 8 + x % 8 + 1]) * 255 THEN 1 << CAST(7 - x % 8 AS INTEGER) ELSE 0 END) AS BIGINT) AS packed FROM px GROUP BY 1, 2", X.PIXELS_SQL)
def q_ordered_dither_r1(spark, sf_dir):
    return raster.pack_r1(X.pixels(spark, sf_dir), "r")


@query(
    """, e AS (SELECT x, y, r - (((r * 62 + 255) // 510) * 510 + 31) // 62 AS dr, g - (((g * 126 + 255) // 510) * 510 + 63) // 126 AS dg FROM px)
SELECT round(-10 * log10(avg(dr * dr) / 65025.0::DOUBLE), 6) AS psnr_r, round(-10 * log10(avg(dg * dg) / 65025.0::DOUBLE), 6) AS psnr_g FROM e""",
    X.PIXELS_SQL,
)
def q_psnr(spark, sf_dir):
    back = raster.unpack_565(X.pixels(spark, sf_dir).select("x", "y", "r", "g", "b", raster.pack_565(F.col("r"), F.col("g"), F.col("b")).alias("w")))
    return back.agg(raster.psnr(F.col("r"), F.col("r2")).alias("psnr_r"), raster.psnr(F.col("g"), F.col("g2")).alias("psnr_g"))


@query(
    """, n AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px), e AS (SELECT x // 4 AS cx, y // 4 AS cy, sum(r) AS s1, sum((((r * 62 + 255) // 510) * 510 + 31) // 62) AS s2 FROM px GROUP BY 1, 2)
SELECT round(sum(abs(s1 - s2) / 16.0::DOUBLE) / (max(w) // 4 * max(h) // 4), 6) AS region_error FROM e, n WHERE cx < w // 4 AND cy < h // 4""",
    X.PIXELS_SQL.replace("100", "97"),
)
def q_region_error(spark, sf_dir):
    back = raster.unpack_565(X.pixels(spark, sf_dir, 97).select("x", "y", "r", "g", "b", raster.pack_565(F.col("r"), F.col("g"), F.col("b")).alias("w")))
    return raster.region_error(back, "r", "r2")


@query(
    """, h AS (SELECT x, y, (coalesce(lag(r, 2) OVER w, lag(r) OVER w, r) + 4 * coalesce(lag(r) OVER w, r) + 6 * r + 4 * coalesce(lead(r) OVER w, r) + coalesce(lead(r, 2) OVER w, lead(r) OVER w, r)) AS blur16 FROM px WINDOW w AS (PARTITION BY y ORDER BY x))
SELECT x, y, CAST(blur16 AS BIGINT) AS blur16 FROM h""",
    X.PIXELS_SQL,
)
def q_blur_row(spark, sf_dir):
    return raster.blur_row(X.pixels(spark, sf_dir), "r").select("x", "y", "blur16")


@query(
    """, f AS (SELECT * FROM (VALUES ('+X', 2, 1), ('-X', 0, 1), ('+Y', 1, 0), ('-Y', 1, 2), ('+Z', 1, 1), ('-Z', 3, 1)) t(face, gx, gy)), s AS (SELECT x, y, r, ['+X','-X','+Y','-Y','+Z','-Z'][(y // 10) % 6 + 1] AS face FROM px)
SELECT s.x + f.gx * 100 AS x, s.y % 10 + f.gy * 10 AS y, s.y // 60 AS cube, s.r FROM s JOIN f USING (face)""",
    X.PIXELS_SQL,
)
def q_cube_layout(spark, sf_dir):
    px = X.pixels(spark, sf_dir)
    faces = F.array(*map(F.lit, layout.FACES))
    tall = px.select("x", F.pmod("y", F.lit(10)).alias("y"), "r", F.floor(F.col("y") / 60).cast("long").alias("cube"), F.get(faces, F.pmod(F.floor(F.col("y") / 10), F.lit(6)).cast("int")).alias("face"))
    return raster.cube_canvas(tall, X.WIDTH, 10).select("x", "y", "cube", "r")


@query("SELECT byte, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_transform(range(octet_length(encode(text))), lambda i: CAST(concat('0x', substr(hex(encode(text)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))) AS byte FROM documents WHERE text IS NOT NULL) GROUP BY byte")
def q_text_histogram(spark, sf_dir):
    return raster.byte_histogram(X.table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("data")))


# -- blocks ------------------------------------------------------------------------------------------------------------

_SUB = "WITH one AS (SELECT 1)"
_P = ", p AS (SELECT unnest(range(16)) AS pixel)"


def _bc1_sql(at: int, force: bool) -> str:
    b = lambda i: f"block[{at + i + 1}]"
    four = "true" if force else "c0 > c1"
    pick = lambda top, lo: f"""CASE idx WHEN 0 THEN ({lo[0]} * 510 + {top}) // (2 * {top}) WHEN 1 THEN ({lo[1]} * 510 + {top}) // (2 * {top})
 WHEN 2 THEN (CASE WHEN four THEN (({lo[0]} * 2 + {lo[1]}) * 510 + {3 * top}) // {6 * top} ELSE (({lo[0]} + {lo[1]}) * 510 + {2 * top}) // {4 * top} END)
 ELSE (CASE WHEN four THEN (({lo[0]} + {lo[1]} * 2) * 510 + {3 * top}) // {6 * top} ELSE 0 END) END"""  # noqa: E731
    return f""", c AS (SELECT doc_id, k, block, {b(0)} + {b(1)} * 256 AS c0, {b(2)} + {b(3)} * 256 AS c1, {b(4)} + {b(5)} * 256 + {b(6)} * 65536 + {b(7)} * 16777216 AS bits FROM bl),
i AS (SELECT doc_id, k, pixel, {four} AS four, c0, c1, (bits >> CAST(2 * pixel AS INTEGER)) & 3 AS idx FROM c, p)
SELECT doc_id, k, pixel, {pick(31, ("(c0 >> 11)", "(c1 >> 11)"))} AS r, {pick(63, ("((c0 >> 5) & 63)", "((c1 >> 5) & 63)"))} AS g, {pick(31, ("(c0 & 31)", "(c1 & 31)"))} AS b, CAST(CASE WHEN idx = 3 AND NOT four THEN 0 ELSE 255 END AS BIGINT) AS a FROM i"""


def _exploded(df, *columns):
    return df.select("doc_id", "k", F.posexplode(F.arrays_zip(*columns)).alias("pixel", "v")).withColumn("pixel", F.col("pixel").cast("long"))


@query(_P + _bc1_sql(0, False), X.BLOCKS_SQL)
def q_bc1_decode(spark, sf_dir):
    blocks = X.block_bytes(spark, sf_dir).withColumn("data", F.substring("data", 1, 8))
    return decode.rgba(decode.block_pixels(blocks, "BC1_UNORM"))


@query(_P + " SELECT doc_id, k, pixel, ((block[CAST(pixel // 2 + 1 AS INTEGER)] >> CAST(4 * (pixel % 2) AS INTEGER)) & 15) * 17 AS a FROM bl, p", X.BLOCKS_SQL)
def q_bc2_alpha(spark, sf_dir):
    out = X.blocks(spark, sf_dir).select("doc_id", "k", F.posexplode(B.bc2_alpha(F.col("block"))).alias("pixel", "a"))
    return out.select("doc_id", "k", F.col("pixel").cast("long").alias("pixel"), F.col("a").cast("long").alias("a"))


def _bc4_sql(at: int, name: str) -> str:
    b = lambda i: f"block[{at + i + 1}]"
    idx = " + ".join(f"{b(2 + i)} * {256**i}" for i in range(6))
    return f""", c AS (SELECT doc_id, k, block, {b(0)} AS e0, {b(1)} AS e1, {idx} AS bits FROM bl), i AS (SELECT doc_id, k, pixel, e0, e1, (bits >> CAST(3 * pixel AS INTEGER)) & 7 AS idx FROM c, p)
SELECT doc_id, k, pixel, CASE WHEN idx = 0 THEN e0 WHEN idx = 1 THEN e1 WHEN e0 > e1 THEN ((e0 * (8 - idx) + e1 * (idx - 1)) * 2 + 7) // 14 WHEN idx < 6 THEN ((e0 * (6 - idx) + e1 * (idx - 1)) * 2 + 5) // 10 WHEN idx = 6 THEN 0 ELSE 255 END AS {name} FROM i"""


@query(_P + _bc4_sql(0, "v"), X.BLOCKS_SQL)
def q_bc4_decode(spark, sf_dir):
    blocks = X.block_bytes(spark, sf_dir).withColumn("data", F.substring("data", 1, 8))
    return decode.block_pixels(blocks, "BC4_UNORM").withColumnRenamed("gray", "v")


@query(_P + ", aa AS (" + _SUB + _bc4_sql(0, "a") + "), cc AS (" + _SUB + _bc1_sql(8, False) + ") SELECT cc.doc_id, cc.k, cc.pixel, cc.r, cc.g, cc.b, aa.a FROM cc JOIN aa USING (doc_id, k, pixel)", X.BLOCKS_SQL)
def q_bc3_decode(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC3_UNORM")


def _bc4s_sql(at: int, name: str) -> str:
    b = lambda i: f"block[{at + i + 1}]"
    idx = " + ".join(f"{b(2 + i)} * {256**i}" for i in range(6))
    return f""", c AS (SELECT doc_id, k, CASE WHEN {b(0)} > 127 THEN {b(0)} - 256 ELSE {b(0)} END AS s0, CASE WHEN {b(1)} > 127 THEN {b(1)} - 256 ELSE {b(1)} END AS s1, {idx} AS bits FROM bl),
i AS (SELECT doc_id, k, pixel, s0 > s1 AS wide, greatest(s0 + 127, 0) AS e0, greatest(s1 + 127, 0) AS e1, (bits >> CAST(3 * pixel AS INTEGER)) & 7 AS idx FROM c, p)
SELECT doc_id, k, pixel, CAST(CASE WHEN wide THEN ((CASE idx WHEN 0 THEN e0 * 7 WHEN 1 THEN e1 * 7 ELSE e0 * (8 - idx) + e1 * (idx - 1) END) * 510 + 1778) // 3556
WHEN idx = 6 THEN 0 WHEN idx = 7 THEN 255 ELSE ((CASE idx WHEN 0 THEN e0 * 5 WHEN 1 THEN e1 * 5 ELSE e0 * (6 - idx) + e1 * (idx - 1) END) * 510 + 1270) // 2540 END AS BIGINT) AS {name} FROM i"""


def _two_sql(one) -> str:
    return _P + ", rr AS (" + _SUB + one(0, "r") + "), gg AS (" + _SUB + one(8, "g") + ")"


@query(_two_sql(_bc4s_sql) + " SELECT doc_id, k, pixel, r, g, CAST(128 AS BIGINT) AS b FROM rr JOIN gg USING (doc_id, k, pixel)", X.BLOCKS_SQL)
def q_bc5_snorm(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC5_SNORM")


@query(_two_sql(_bc4_sql) + " SELECT doc_id, k, pixel, r, g, CAST(0 AS BIGINT) AS b FROM rr JOIN gg USING (doc_id, k, pixel)", X.BLOCKS_SQL)
def q_bc5_unorm(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC5_UNORM")


@query(_P + _bc4s_sql(0, "v"), X.BLOCKS_SQL)
def q_bc4_snorm(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir).withColumn("data", F.substring("data", 1, 8)), "BC4_SNORM").withColumnRenamed("gray", "v")


_BC2_SQL = _P + ", aa AS (SELECT doc_id, k, pixel, ((block[CAST(pixel // 2 + 1 AS INTEGER)] >> CAST(4 * (pixel % 2) AS INTEGER)) & 15) * 17 AS a FROM bl, p), cc AS (" + _SUB + _bc1_sql(8, True) + ")"


@query(_BC2_SQL + " SELECT cc.doc_id, cc.k, cc.pixel, cc.r, cc.g, cc.b, aa.a FROM cc JOIN aa USING (doc_id, k, pixel)", X.BLOCKS_SQL)
def q_bc2_decode(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC2_UNORM")


_UNMULTIPLIED = ", ".join(f"least(255, {c} * 255 // CASE WHEN a = 0 THEN 255 ELSE a END) AS {c}" for c in "rgb")


@query(_BC2_SQL + f", m AS (SELECT cc.doc_id, cc.k, cc.pixel, cc.r, cc.g, cc.b, aa.a FROM cc JOIN aa USING (doc_id, k, pixel)) SELECT doc_id, k, pixel, {_UNMULTIPLIED}, a FROM m", X.BLOCKS_SQL)
def q_bc2_premultiplied(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC2_UNORM_PREMULTIPLIED_ALPHA")


_BC3_SQL = _P + ", aa AS (" + _SUB + _bc4_sql(0, "a") + "), cc AS (" + _SUB + _bc1_sql(8, False) + ")"


@query(_BC3_SQL + f", m AS (SELECT cc.doc_id, cc.k, cc.pixel, cc.r, cc.g, cc.b, aa.a FROM cc JOIN aa USING (doc_id, k, pixel)) SELECT doc_id, k, pixel, {_UNMULTIPLIED}, a FROM m", X.BLOCKS_SQL)
def q_bc3_premultiplied(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC3_UNORM_PREMULTIPLIED_ALPHA")


@query(_BC3_SQL + " SELECT cc.doc_id, cc.k, cc.pixel, aa.a AS r, cc.g, cc.b FROM cc JOIN aa USING (doc_id, k, pixel)", X.BLOCKS_SQL)
def q_bc3_rxgb(spark, sf_dir):
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC3_UNORM_RXGB")


@query()
def q_bc7_decode(spark, sf_dir):
    """All modes; tests hold it against a loop over bits."""
    return decode.block_pixels(X.block_bytes(spark, sf_dir), "BC7_UNORM")


def _packed_sql(names: list[str]) -> str:
    """Fields of a little-endian word, widened by rounding, in native precision."""
    parts = []
    for name in names:
        size, (kind, precision) = dims.pixel_info(name)[1], NATIVE[name]
        n, top = 16 // size, 255 if precision == "u8" else 65535
        word = "(" + " + ".join(f"block[CAST(x * {size} + {i + 1} AS INTEGER)]::HUGEINT * {256**i}::HUGEINT" for i in range(size)) + ")"
        value = {}
        for channel, bits, at in named_bits(name):
            v = f"(({word} >> {at}) & {(1 << bits) - 1})"
            if "SNORM" in name:
                half = 1 << (bits - 1)
                code = f"greatest(({v} + {half}) % {2 * half} - 1, 0)"
                value[channel] = f"({code} * {2 * top} + {2 * half - 2}) // {2 * (2 * half - 2)}"
            else:
                value[channel] = f"({v} * {2 * top} + {(1 << bits) - 1}) // {2 * ((1 << bits) - 1)}"
        blank = str((top + 1) // 2 if "SNORM" in name else 0)
        shown = {"grayscale": ["R"] * 3 + [None], "alpha": ["-"] * 3 + ["A"], "rgb": ["R", "G", "B", None], "rgba": ["R", "G", "B", "A"]}[kind]
        columns = [str(top) if c is None else "0" if c == "-" else value.get(c, blank) for c in shown]
        parts.append(f"SELECT doc_id, k, '{name}' AS format, x, " + ", ".join(f"CAST({v} AS BIGINT) AS {c}" for v, c in zip(columns, "rgba", strict=True)) + f" FROM bl, (SELECT unnest(range({n})) AS x)")
    return " UNION ALL ".join(parts)


def _packed(spark, sf_dir, names):
    """Each block's bytes as one row of pixels in each of the formats, as RGBA in native precision."""
    return packed.strip_pixels(X.strips(spark, sf_dir, {name: (16 // dims.pixel_info(name)[1], 1, 16 // dims.pixel_info(name)[1] * dims.pixel_info(name)[1]) for name in names})).drop("y")


_UNORM8 = ["R8G8B8_UNORM", "B8G8R8_UNORM", "R8G8B8A8_UNORM", "B8G8R8A8_UNORM", "B8G8R8X8_UNORM", "B5G6R5_UNORM", "B5G5R5A1_UNORM", "B4G4R4A4_UNORM", "A4B4G4R4_UNORM", "R8_UNORM", "R8G8_UNORM", "A8_UNORM"]
_UNORM16 = ["R16_UNORM", "R16G16_UNORM", "R16G16B16A16_UNORM", "R10G10B10A2_UNORM"]
_SNORM = ["R8G8B8A8_SNORM", "R8_SNORM", "R8G8_SNORM", "R16_SNORM", "R16G16_SNORM", "R16G16B16A16_SNORM"]


@query(_packed_sql(_UNORM8), X.BLOCKS_SQL)
def q_decode_unorm8(spark, sf_dir):
    return _packed(spark, sf_dir, _UNORM8)


@query(_packed_sql(_UNORM16), X.BLOCKS_SQL)
def q_decode_unorm16(spark, sf_dir):
    return _packed(spark, sf_dir, _UNORM16)


@query(_packed_sql(_SNORM), X.BLOCKS_SQL)
def q_decode_snorm(spark, sf_dir):
    return _packed(spark, sf_dir, _SNORM)


@query(
    "SELECT doc_id, k, x, CAST((block[CAST(4 * (x // 2) + 1 AS INTEGER)]) AS BIGINT) AS r, CAST(block[CAST(4 * (x // 2) + 2 + 2 * (x % 2) AS INTEGER)] AS BIGINT) AS g, CAST(block[CAST(4 * (x // 2) + 3 AS INTEGER)] AS BIGINT) AS b FROM bl, (SELECT unnest(range(8)) AS x)",
    X.BLOCKS_SQL,
)
def q_decode_rgbg(spark, sf_dir):
    strips = X.block_bytes(spark, sf_dir).withColumns({"width": F.lit(8), "rows": F.lit(1)})
    return decode.strip_pixels(strips, "R8G8_B8G8_UNORM").drop("y")


@query("SELECT doc_id, k, x, CAST(((block[CAST(x // 8 + 1 AS INTEGER)] >> CAST(7 - x % 8 AS INTEGER)) & 1) * 255 AS BIGINT) AS v FROM bl, (SELECT unnest(range(128)) AS x)", X.BLOCKS_SQL)
def q_decode_r1(spark, sf_dir):
    strips = X.block_bytes(spark, sf_dir).withColumns({"width": F.lit(128), "rows": F.lit(1)})
    return decode.strip_pixels(strips, "R1_UNORM").drop("y").withColumnRenamed("gray", "v")


@query(
    """, m AS (SELECT CASE """ + " ".join(f"WHEN block[1] & {1 << i} <> 0 THEN {i}" for i in range(8)) + """ ELSE 8 END AS mode FROM bl) SELECT CAST(mode AS BIGINT) AS mode, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY 1""",
    X.BLOCKS_SQL,
)
def q_bc7_mode_hist(spark, sf_dir):
    return X.blocks(spark, sf_dir).groupBy(B.bc7_mode(F.col("block")).cast("long").alias("mode")).agg(F.count("*").cast("long").alias("n"))


@query(
    _P + """, z AS (SELECT doc_id, k, [64] || block[2:16] AS block FROM bl),
t AS (SELECT doc_id, k, list_transform(range(128), lambda i: (block[CAST(i // 8 + 1 AS INTEGER)] >> CAST(i % 8 AS INTEGER)) & 1) AS t FROM z),
e AS (SELECT doc_id, k, t, list_transform(range(8), lambda c: list_sum(list_transform(range(7), lambda j: t[CAST(7 + 7 * c + j + 1 AS INTEGER)] << CAST(j AS INTEGER))) * 2 + t[CAST(64 + c % 2 AS INTEGER)]) AS e FROM t),
x AS (SELECT doc_id, k, pixel, e, [0,4,9,13,17,21,26,30,34,38,43,47,51,55,60,64][CAST((CASE WHEN pixel = 0 THEN t[66] + 2 * t[67] + 4 * t[68] ELSE t[CAST(65 + 4 * pixel AS INTEGER)] + 2 * t[CAST(66 + 4 * pixel AS INTEGER)] + 4 * t[CAST(67 + 4 * pixel AS INTEGER)] + 8 * t[CAST(68 + 4 * pixel AS INTEGER)] END) + 1 AS INTEGER)] AS w FROM e, p)
SELECT doc_id, k, pixel, CAST(((64 - w) * e[1] + w * e[2] + 32) // 64 AS BIGINT) AS r, CAST(((64 - w) * e[3] + w * e[4] + 32) // 64 AS BIGINT) AS g, CAST(((64 - w) * e[5] + w * e[6] + 32) // 64 AS BIGINT) AS b, CAST(((64 - w) * e[7] + w * e[8] + 32) // 64 AS BIGINT) AS a FROM x""",
    X.BLOCKS_SQL,
)
def q_bc7_mode6_decode(spark, sf_dir):
    mode6 = X.block_bytes(spark, sf_dir).withColumn("data", F.concat(F.unhex(F.lit("40")), F.substring("data", 2, 15)))
    return decode.block_pixels(mode6, "BC7_UNORM")


@query("SELECT vec_id, min(r) AS min_r, max(r) AS max_r, min(a) AS min_a, bool_and(a = 255) AS opaque, CAST(count(DISTINCT (r, g, b)) AS BIGINT) AS n_colors FROM vp GROUP BY vec_id", X.VECTORS_SQL)
def q_block_stats(spark, sf_dir):
    return raster.block_stats(X.vectors(spark, sf_dir), ["vec_id"])


@query(
    """, e AS (SELECT vec_id, min(r) AS lo, max(r) AS hi FROM vp GROUP BY vec_id), q AS (SELECT vec_id, i, r, list_transform(range(8), lambda j: (lo * (7 - j) + hi * j) // 7) AS pal FROM vp JOIN e USING (vec_id)),
d AS (SELECT vec_id, i, list_transform(range(8), lambda j: (pal[CAST(j + 1 AS INTEGER)] - r) * (pal[CAST(j + 1 AS INTEGER)] - r)) AS err FROM q)
SELECT vec_id, CAST(sum(list_min(err)) AS BIGINT) AS error, CAST(sum(list_position(err, list_min(err)) - 1) AS BIGINT) AS index_sum FROM d GROUP BY vec_id""",
    X.VECTORS_SQL,
)
def q_block_palette_argmin(spark, sf_dir):
    v = X.vectors(spark, sf_dir)
    w = Window.partitionBy("vec_id")
    lo, hi = F.col("lo"), F.col("hi")
    palette = F.array(*(F.floor((lo * (7 - j) + hi * j) / 7.0 + 1e-9).cast("long") for j in range(8)))
    best = v.select("vec_id", "r", F.min("r").over(w).alias("lo"), F.max("r").over(w).alias("hi")).select("vec_id", B.nearest(F.col("r"), palette).alias("n"))
    return best.groupBy("vec_id").agg(F.sum("n.error").cast("long").alias("error"), F.sum("n.index").cast("long").alias("index_sum"))


_TWO_SQL = "pt AS (SELECT * FROM (VALUES " + ", ".join(f"({p}, '{row}')" for p, row in enumerate(bc_tables.TWO)) + ") t(part, subsets))"


@query(
    """, s AS (SELECT vec_id, part, CAST(substr(subsets, CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS sub, r, g, b FROM vp, pt),
g AS (SELECT vec_id, part, sub, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b, sum(r * r + g * g + b * b) AS q FROM s GROUP BY ALL),
e AS (SELECT vec_id, part, round(sum(q - (r * r + g * g + b * b) / CAST(n AS DOUBLE)), 6) AS error FROM g GROUP BY ALL)
SELECT vec_id, CAST(part AS BIGINT) AS part, CAST(rank AS BIGINT) AS rank, error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY error, part) AS rank FROM e) WHERE rank <= 4""",
    X.VECTORS_SQL, _TWO_SQL,
)
def q_top_partitions(spark, sf_dir):
    """The four partitions into two subsets whose colours lie closest to their means."""
    return raster.top_partitions(X.vectors(spark, sf_dir), "vec_id", 4)


# -- headers and layout ------------------------------------------------------------------------------------------------

_FORMATS_SQL = "fm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r[0]}', '{r[12]}', {r[13]}, {r[14]}, {r[15]}, {r[16]}, {r[17]}, {r[18]}, {r[19]}, {'NULL' if r[6] is None else r[6]})" for i, r in enumerate(dims.format_rows())) + ") t(format_no, format, kind, bytes, block_w, block_h, plane1, plane2, sub_x, sub_y, dxgi))"
_BYTES = "CASE kind WHEN 'fixed' THEN {w} * {h} * bytes WHEN 'block' THEN (({w} + block_w - 1) // block_w) * (({h} + block_h - 1) // block_h) * bytes ELSE plane1 * {w} * {h} + plane2 * (({w} + sub_x - 1) // sub_x) * (({h} + sub_y - 1) // sub_y) END"


def _with_info(spark, sf_dir):
    rows = [(i, r[0], *r[12:20], r[6]) for i, r in enumerate(dims.format_rows())]
    fm = local_table(spark, rows, "format_no long, format string, kind string, bytes int, block_w int, block_h int, plane1 int, plane2 int, sub_x int, sub_y int, dxgi int")
    return X.orders(spark, sf_dir).join(F.broadcast(fm), "format_no")


@query(
    f""", s AS (SELECT file_id, format, {_BYTES.format(w="width", h="height")} AS n, CASE kind WHEN 'fixed' THEN bytes * 8 WHEN 'block' THEN (bytes * 8 + block_w * block_h - 1) // (block_w * block_h) ELSE plane1 * 8 + (plane2 * 8 + sub_x * sub_y - 1) // (sub_x * sub_y) END AS bpp FROM od JOIN fm USING (format_no))
SELECT file_id, format, CAST(n AS BIGINT) AS n_bytes, CAST(bpp AS BIGINT) AS bits_per_pixel FROM s""",
    X.ORDERS_SQL, _FORMATS_SQL,
)
def q_surface_bytes(spark, sf_dir):
    d = _with_info(spark, sf_dir)
    return d.select("file_id", "format", layout.surface_bytes(F.col("width"), F.col("height")).cast("long").alias("n_bytes"), layout.bits_per_pixel().cast("long").alias("bits_per_pixel"))


_LEVELS_SQL = f"""lv AS (SELECT file_id, format, shape, depth, array_size, face_mask, mip, greatest(width >> CAST(mip AS INTEGER), 1) AS w, greatest((CASE WHEN shape = 1 THEN 1 ELSE height END) >> CAST(mip AS INTEGER), 1) AS h,
 CASE WHEN shape = 2 THEN greatest(depth >> CAST(mip AS INTEGER), 1) ELSE 1 END AS d, kind, bytes, block_w, block_h, plane1, plane2, sub_x, sub_y FROM od JOIN fm USING (format_no), (SELECT unnest(range(12)) AS mip) WHERE mip < mips),
ln AS (SELECT *, {_BYTES.format(w="w", h="h")} AS len FROM lv),
ofs AS (SELECT *, coalesce(sum(len * d) OVER (PARTITION BY file_id ORDER BY mip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level_offset, sum(len * d) OVER (PARTITION BY file_id) AS element_len FROM ln)"""


def _synthetic_headers(spark, sf_dir):
    d = _with_info(spark, sf_dir)
    shape = F.col("shape")
    faces = F.when(F.col("face_mask") == 0, 1).otherwise(F.col("face_mask"))
    return d.select(
        "file_id", "format", "shape", "width", "height", F.when(shape == 2, F.col("depth")).alias("depth"), F.col("mips").alias("mipmap_count"),
        F.when(shape == 4, "dx9").otherwise("dx10").alias("version"), F.when(shape == 4, F.lit(0x200) + faces * 1024).cast("long").alias("caps2"),
        F.when(shape == 1, 2).when(shape == 2, 4).when(shape != 4, 3).cast("int").alias("resource_dim"), F.when(shape == 3, 4).when(shape != 4, 0).cast("long").alias("misc"),
        F.when(shape == 2, 1).when(shape != 4, F.col("array_size")).cast("long").alias("array_size"), *layout.INFO,
    )


def _surfaces(spark, sf_dir, shapes):
    laid = layout.with_layout(_synthetic_headers(spark, sf_dir).filter(F.col("shape").isin(*shapes)))
    return layout.surfaces(laid)


_SURFACE_COLUMNS = ["file_id", "array_index", "mip_level", "depth_slice", "width", "height", "offset", "len"]


def _plain(df):
    return df.select(*(F.col(c).cast("long").alias(c) for c in _SURFACE_COLUMNS))


@query(
    """SELECT file_id, CAST(e AS BIGINT) AS array_index, CAST(mip AS BIGINT) AS mip_level, CAST(0 AS BIGINT) AS depth_slice, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(e * element_len + level_offset AS BIGINT) AS "offset", CAST(len AS BIGINT) AS len
FROM ofs, (SELECT unnest(range(4)) AS e) WHERE shape IN (0, 1) AND e < array_size""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_layout_mips(spark, sf_dir):
    return _plain(_surfaces(spark, sf_dir, (0, 1)))


@query(
    """SELECT file_id, CAST(0 AS BIGINT) AS array_index, CAST(mip AS BIGINT) AS mip_level, CAST(z AS BIGINT) AS depth_slice, CAST(w AS BIGINT) AS width, CAST(h AS BIGINT) AS height, CAST(level_offset + z * len AS BIGINT) AS "offset", CAST(len AS BIGINT) AS len
FROM ofs, (SELECT unnest(range(8)) AS z) WHERE shape = 2 AND z < d""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_layout_volume(spark, sf_dir):
    return _plain(_surfaces(spark, sf_dir, (2,)))


@query(
    """SELECT file_id, ['+X','-X','+Y','-Y','+Z','-Z'][e % 6 + 1] AS face, CAST(e AS BIGINT) AS array_index, CAST(mip AS BIGINT) AS mip_level, CAST(e * element_len + level_offset AS BIGINT) AS "offset" FROM ofs, (SELECT unnest(range(18)) AS e) WHERE shape = 3 AND e < array_size * 6""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_layout_cube(spark, sf_dir):
    s = _surfaces(spark, sf_dir, (3,))
    return s.select("file_id", "face", F.col("array_index").cast("long").alias("array_index"), F.col("mip_level").cast("long").alias("mip_level"), F.col("offset").cast("long").alias("offset"))


@query(
    """, b AS (SELECT file_id, mip, level_offset, element_len, CASE WHEN face_mask = 0 THEN 1 ELSE face_mask END AS fm2 FROM ofs WHERE shape = 4),
f AS (SELECT *, j, bit_count(CAST(fm2 & ((1 << CAST(j AS INTEGER)) - 1) AS BIGINT)) AS e FROM b, (SELECT unnest(range(6)) AS j) WHERE fm2 & (1 << CAST(j AS INTEGER)) <> 0)
SELECT file_id, ['+X','-X','+Y','-Y','+Z','-Z'][j + 1] AS face, CAST(e AS BIGINT) AS array_index, CAST(mip AS BIGINT) AS mip_level, CAST(e * element_len + level_offset AS BIGINT) AS "offset" FROM f""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_layout_partial_cube(spark, sf_dir):
    s = _surfaces(spark, sf_dir, (4,))
    return s.select("file_id", "face", F.col("array_index").cast("long").alias("array_index"), F.col("mip_level").cast("long").alias("mip_level"), F.col("offset").cast("long").alias("offset"))


@query(
    """SELECT file_id, CAST(sum(len * d) * max(CASE shape WHEN 2 THEN 1 WHEN 3 THEN array_size * 6 WHEN 4 THEN bit_count(CAST(CASE WHEN face_mask = 0 THEN 1 ELSE face_mask END AS BIGINT)) ELSE array_size END) AS BIGINT) AS data_len FROM ln GROUP BY file_id""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_layout_len(spark, sf_dir):
    return layout.with_layout(_synthetic_headers(spark, sf_dir)).select("file_id", F.col("data_len").cast("long").alias("data_len"))


def _raw(spark, sf_dir):
    """Headers as words: every seventh is marred in one of four ways."""
    d = _with_info(spark, sf_dir)
    dx10 = F.col("dxgi").isNotNull() & (F.col("shape") != 4)
    bad = F.when(F.col("file_id") % 7 == 0, F.floor(F.col("file_id") / 7) % 4 + 1).otherwise(0)
    values = {
        "size": F.when(bad == 1, 24).otherwise(124), "flags": F.lit(0x21007), "height": F.col("height"), "width": F.col("width"), "mipmap_count": F.col("mips"), "depth": F.lit(1), "pf_size": F.when(bad == 2, 24).otherwise(32),
        "pf_flags": F.when(dx10, 4).when(bad == 3, 0).otherwise(4), "four_cc": F.when(dx10, container.DX10).otherwise(dims.fourcc_number("DXT5")), "caps": F.lit(0x1000),
    }
    ext = {"dxgi": F.when(bad == 4, 116).otherwise(F.col("dxgi")), "resource_dim": F.lit(3), "misc": F.lit(0), "array_size": F.lit(1), "misc2": F.col("file_id") % 8}
    return d.select("file_id", *(values.get(w, F.lit(0)).cast("long").alias(w) for w in container.WORDS), *(F.when(dx10, ext[w].cast("long")).alias(w) for w in container.DX10_WORDS), dx10.alias("has_dx10"))


_RAW_SQL = """rw AS (SELECT file_id, width, height, mips, dxgi IS NOT NULL AND shape <> 4 AS dx10, CASE WHEN file_id % 7 = 0 THEN (file_id // 7) % 4 + 1 ELSE 0 END AS bad, dxgi, file_id % 8 AS alpha FROM od JOIN fm USING (format_no))"""


def _files(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    return raw.select("file_id", container.write_raw(raw).alias("content"))


@query(
    """SELECT file_id, CAST(CASE WHEN bad = 1 THEN 24 ELSE 124 END AS BIGINT) AS size, width, height, CAST(mips AS BIGINT) AS mipmap_count, CAST(CASE WHEN dx10 THEN 808540228 ELSE 894720068 END AS BIGINT) AS four_cc, CAST(CASE WHEN dx10 AND NOT (bad = 3 AND NOT dx10) THEN (CASE WHEN bad = 4 THEN 116 ELSE dxgi END) END AS BIGINT) AS dxgi FROM rw""",
    X.ORDERS_SQL, _FORMATS_SQL, _RAW_SQL,
)
def q_header_words(spark, sf_dir):
    return container.raw_words(_files(spark, sf_dir)).select("file_id", "size", "width", "height", "mipmap_count", "four_cc", "dxgi")


def _parsed(spark, sf_dir, lax):
    p = container.parse(container.raw_words(_files(spark, sf_dir)), container.ParseOptions(permissive=lax))
    return p.select("file_id", F.col("error.code").alias("error"), "version", "mipmap_count", F.col("dxgi").cast("long").alias("dxgi"), F.col("alpha_mode").cast("long").alias("alpha_mode"))


@query(
    """, e AS (SELECT *, CASE WHEN bad = 1 THEN 'InvalidHeaderSize' WHEN bad = 2 THEN 'InvalidPixelFormatSize' WHEN bad = 3 AND NOT dx10 THEN 'InvalidRgbBitCount' WHEN bad = 4 AND dx10 THEN 'InvalidDxgiFormat' WHEN dx10 AND alpha > 4 THEN 'InvalidAlphaMode' END AS error FROM rw)
SELECT file_id, error, CASE WHEN error IS NULL THEN (CASE WHEN dx10 THEN 'dx10' ELSE 'dx9' END) END AS version, CASE WHEN error IS NULL THEN CAST(mips AS BIGINT) END AS mipmap_count, CASE WHEN error IS NULL AND dx10 THEN CAST(dxgi AS BIGINT) END AS dxgi, CASE WHEN error IS NULL AND dx10 THEN CAST(alpha AS BIGINT) END AS alpha_mode FROM e""",
    X.ORDERS_SQL, _FORMATS_SQL, _RAW_SQL,
)
def q_header_strict(spark, sf_dir):
    return _parsed(spark, sf_dir, False)


@query(
    """, e AS (SELECT *, CASE WHEN bad = 4 AND dx10 THEN 'InvalidDxgiFormat' END AS error FROM rw)
SELECT file_id, error, CASE WHEN error IS NULL THEN (CASE WHEN dx10 THEN 'dx10' ELSE 'dx9' END) END AS version, CASE WHEN error IS NULL THEN CAST(mips AS BIGINT) END AS mipmap_count, CASE WHEN error IS NULL AND dx10 THEN CAST(dxgi AS BIGINT) END AS dxgi, CASE WHEN error IS NULL AND dx10 THEN CAST(CASE WHEN alpha > 4 THEN 0 ELSE alpha END AS BIGINT) END AS alpha_mode FROM e""",
    X.ORDERS_SQL, _FORMATS_SQL, _RAW_SQL,
)
def q_header_permissive(spark, sf_dir):
    return _parsed(spark, sf_dir, True)


@query(
    """, e AS (SELECT *, CASE WHEN bad = 4 AND dx10 THEN NULL WHEN NOT dx10 THEN 'BC3_UNORM' WHEN dxgi = 74 AND alpha = 2 THEN 'BC2_UNORM_PREMULTIPLIED_ALPHA' WHEN dxgi = 77 AND alpha = 2 THEN 'BC3_UNORM_PREMULTIPLIED_ALPHA' WHEN dxgi = 77 THEN 'BC3_UNORM' ELSE format END AS f FROM rw JOIN (SELECT file_id, format FROM od JOIN fm USING (format_no)) USING (file_id))
SELECT file_id, f AS format FROM e""",
    X.ORDERS_SQL, _FORMATS_SQL, _RAW_SQL,
)
def q_format_lookup(spark, sf_dir):
    p = container.parse(container.raw_words(_files(spark, sf_dir)), container.ParseOptions(permissive=True))
    return container.with_format(p).select("file_id", "format")


# Every FourCC, then every mask pattern; what a legacy pixel format is in the extended header, null where there is none.
_LEGACY = [(c, 4, 0, 0, 0, 0, 0) for c, *_ in dims.fourcc_rows()] + [(0, *r[1:7]) for r in dims.mask_rows()]
_PREMULTIPLIED = {dims.fourcc_number("DXT2"): 74, dims.fourcc_number("DXT4"): 77}
_LEGACY_DXGI = [(_PREMULTIPLIED.get(c, d), 2 if c in _PREMULTIPLIED else 0) for c, d, _ in dims.fourcc_rows()] + [(r[7], 0) for r in dims.mask_rows()]
_LEGACY_SQL = "lg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if d is None else d}, {a})" for i, (d, a) in enumerate(_LEGACY_DXGI)) + f") t(no, dxgi, alpha)), lh AS (SELECT o_orderkey AS file_id, o_orderkey % {len(_LEGACY)} AS no, o_custkey % 4 AS shape FROM orders)"


def _legacy_files(spark, sf_dir):
    """Legacy headers of every FourCC and mask: plain, whole cubes, cubes without a face, and volumes."""
    rows = local_table(spark, [(i, *r) for i, r in enumerate(_LEGACY)], "no long, four_cc long, pf_flags long, bits long, r_mask long, g_mask long, b_mask long, a_mask long")
    od = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % len(_LEGACY)).alias("no"), (F.col("o_custkey") % 4).alias("shape")).join(F.broadcast(rows), "no")
    caps2 = F.when(F.col("shape") == 1, container.C2_CUBE | container.C2_FACES).when(F.col("shape") == 2, container.C2_CUBE | 0x400).when(F.col("shape") == 3, container.C2_VOLUME).otherwise(0)
    values = {"size": F.lit(124), "flags": F.when(F.col("shape") == 3, 0x801007).otherwise(0x1007), "height": F.lit(64), "width": F.lit(64), "depth": F.lit(8), "pf_size": F.lit(32), "caps": F.lit(0x1000), "caps2": caps2} | {c: F.col(c) for c in ("four_cc", "pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask")}
    words = od.select("file_id", *(values.get(w, F.lit(0)).cast("long").alias(w) for w in container.WORDS), *(F.lit(None).cast("long").alias(w) for w in container.DX10_WORDS), F.lit(False).alias("has_dx10"))
    return words.select("file_id", container.write_raw(words).alias("content"))


@query(
    """SELECT file_id, CAST(CASE WHEN shape <> 2 THEN dxgi END AS INTEGER) AS dxgi, CAST(CASE WHEN shape = 3 THEN 4 ELSE 3 END AS INTEGER) AS resource_dim, CAST(CASE WHEN shape IN (1, 2) THEN 4 ELSE 0 END AS BIGINT) AS misc, CAST(alpha AS INTEGER) AS alpha_mode FROM lh JOIN lg USING (no)""",
    _LEGACY_SQL,
)
def q_dx9_dx10(spark, sf_dir):
    p = container.parse(container.raw_words(_legacy_files(spark, sf_dir)), container.ParseOptions(permissive=True)).filter("version = 'dx9'")
    return container.to_dx10(p).select("file_id", "dxgi", "resource_dim", "misc", "alpha_mode")


@query(
    """SELECT file_id, CAST(array_index AS BIGINT) AS array_index, CAST(mip_level AS BIGINT) AS mip_level, 'MissingSurfaces' AS status FROM (SELECT file_id, e AS array_index, mip AS mip_level FROM ofs, (SELECT unnest(range(4)) AS e) WHERE shape = 0 AND e < array_size) WHERE (file_id + mip_level) % 11 = 0""",
    X.ORDERS_SQL, _FORMATS_SQL, _LEVELS_SQL,
)
def q_sink_missing(spark, sf_dir):
    expected = _surfaces(spark, sf_dir, (0,))
    written = expected.filter((F.col("file_id") + F.col("mip_level")) % 11 != 0)
    return layout.missing_surfaces(expected, written).select("file_id", F.col("array_index").cast("long").alias("array_index"), F.col("mip_level").cast("long").alias("mip_level"), "status")
