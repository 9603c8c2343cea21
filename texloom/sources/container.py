"""Texture container headers as DataFrames: read raw words, parse strictly or permissively, repair, write.

The words of the first 148 bytes are read batch by batch, all else is Column expressions over them; bad files become rows
with an `error`, they never fail the job. Flag values are those of the public DDS header documentation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from texloom.functions import formats as dims
from texloom.functions.local import local_table
from texloom.operators import layout

MAGIC = 0x20534444  # "DDS " as a little-endian word
DX10 = int.from_bytes(b"DX10", "little")
# Header flags.
F_CAPS, F_HEIGHT, F_WIDTH, F_PITCH, F_PIXEL_FORMAT, F_MIPMAP_COUNT, F_LINEAR_SIZE, F_DEPTH = 0x1, 0x2, 0x4, 0x8, 0x1000, 0x20000, 0x80000, 0x800000
C_COMPLEX, C_TEXTURE, C_MIPMAP = 0x8, 0x1000, 0x400000
C2_CUBE, C2_VOLUME, C2_FACES = 0x200, 0x200000, 0xFC00
PF_FOURCC, MISC_CUBE = 0x4, 0x4

# Words of the header by position; eleven reserved words follow mipmap_count.
WORDS = ["size", "flags", "height", "width", "pitch", "depth", "mipmap_count", *(f"reserved{i}" for i in range(11)), "pf_size", "pf_flags", "four_cc", "bits", "r_mask", "g_mask", "b_mask", "a_mask", "caps", "caps2", "caps3", "caps4", "reserved_end"]
DX10_WORDS = ["dxgi", "resource_dim", "misc", "array_size", "misc2"]


@dataclass(frozen=True)
class ParseOptions:
    """skip_magic: the content has no magic bytes; permissive: accept and repair known faults of writers."""

    skip_magic: bool = False
    permissive: bool = False


def raw_words(files: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """`files` with a column for each word of the header, and the extension's words where it has one (else null).

    One view of each batch's first bytes as little-endian words: the columns are plain ones for whatever is built on them.
    Words beyond the end of the content are null."""
    base = 0 if options.skip_magic else 4
    names = [*WORDS, *DX10_WORDS]
    length = base + 4 * len(names)
    own = [c for c in files.columns if c != "content"]
    schema = StructType([files.schema[c] for c in own] + [StructField(c, LongType()) for c in ("magic", *names)] + [StructField("has_dx10", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [x or b"" for x in batch.column("content").to_pylist()]
            table = np.frombuffer(b"".join(x[:length].ljust(length, b"\0") for x in heads), "<u4").reshape(len(heads), length // 4).astype(np.int64)
            there = np.minimum(np.array([len(x) for x in heads], np.int64), length)[:, None] >= 4 * np.arange(1, length // 4 + 1)
            magic = pa.array(np.full(len(heads), MAGIC)) if options.skip_magic else pa.array(table[:, 0], mask=~there[:, 0])
            table, there = table[:, base // 4 :], there[:, base // 4 :]
            at = {w: i for i, w in enumerate(names)}
            extended = (table[:, at["pf_flags"]] & PF_FOURCC != 0) & (table[:, at["four_cc"]] == DX10) & there[:, at["four_cc"]]
            words = [pa.array(table[:, i], mask=~(there[:, i] & (extended if w in DX10_WORDS else True))) for w, i in at.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), magic, *words, pa.array(extended)], [*own, "magic", *names, "has_dx10"])

    return files.select(*own, F.substring("content", 1, length).alias("content")).mapInArrow(run, schema)


def _digits(word: Column) -> Column:
    """Eight hex digits of a word's bytes in little-endian order: the word with its bytes turned round."""
    byte = lambda at: F.shiftright(word, at).bitwiseAND(255)
    turned = byte(0) * (1 << 24) + byte(8) * (1 << 16) + byte(16) * (1 << 8) + byte(24)
    return F.lpad(F.hex(turned), 8, "0")


def write_raw(headers: DataFrame) -> Column:
    """The bytes of a header's words, with the magic bytes."""
    plain = [_digits(F.lit(MAGIC).cast("long")), *(_digits(F.col(w)) for w in WORDS)]
    extension = F.when(F.col("has_dx10"), F.concat(*(_digits(F.col(w)) for w in DX10_WORDS))).otherwise("")
    return F.unhex(F.concat(*plain, extension))


def has(flags: str, bit: int) -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def parse(words: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Headers from raw words: version, dimensions, pixel format, and error (code, detail), which is null for a valid one."""
    lax = options.permissive
    mend = lambda ok, bad: ok if lax else bad
    infer = (F.col("bits") == 0) & (F.col("four_cc") != 0) & ~has("pf_flags", PF_FOURCC)
    flags = F.when(infer, F.col("pf_flags").bitwiseOR(PF_FOURCC)).otherwise(F.col("pf_flags")) if lax else F.col("pf_flags")
    words = words.withColumn("pf_flags", flags)
    alpha = F.col("misc2").bitwiseAND(7)
    known = F.array(*(F.lit(c).cast("long") for c in dims.DXGI))
    dx10 = F.col("has_dx10")
    checks = [
        ("InvalidMagicBytes", F.col("magic").isNull() | (F.col("magic") != MAGIC), "magic"),
        ("Io", F.col("reserved_end").isNull() | (dx10 & F.col("misc2").isNull()), "reserved_end"),
        ("InvalidHeaderSize", mend(~F.col("size").isin(124, 24), F.col("size") != 124), "size"),
        ("InvalidPixelFormatSize", mend(~F.col("pf_size").isin(32, 24, 0), F.col("pf_size") != 32), "pf_size"),
        ("InvalidRgbBitCount", ~has("pf_flags", PF_FOURCC) & ~F.col("bits").isin(8, 16, 24, 32), "bits"),
        ("InvalidDxgiFormat", dx10 & ~F.array_contains(known, F.coalesce("dxgi", F.lit(-1).cast("long"))), "dxgi"),
        ("InvalidResourceDimension", dx10 & ~F.col("resource_dim").isin(2, 3, 4), "resource_dim"),
    ]
    if not lax:
        checks += [("InvalidAlphaMode", dx10 & (alpha > 4), "misc2"), ("InvalidArraySizeForTexture3D", dx10 & (F.col("resource_dim") == 4) & (F.col("array_size") != 1), "array_size")]
    error = F.lit(None).cast("struct<code:string,detail:string>")
    for code, bad, detail in reversed(checks):
        value = alpha if code == "InvalidAlphaMode" else F.col(detail)
        error = F.when(bad, F.struct(F.lit(code).alias("code"), value.cast("string").alias("detail"))).otherwise(error)
    counted = has("flags", F_MIPMAP_COUNT) | has("caps", C_COMPLEX) | has("caps", C_MIPMAP)
    mask = ~has("pf_flags", PF_FOURCC)
    array = F.when((F.col("resource_dim") == 4), F.lit(1).cast("long")).otherwise(F.col("array_size"))
    own = [c for c in words.columns if c not in {"magic", "has_dx10", *WORDS, *DX10_WORDS}]
    out = words.select(
        *own, error.alias("error"), F.when(dx10, "dx10").otherwise("dx9").alias("version"), "width", "height",
        F.when(has("flags", F_DEPTH), F.col("depth")).alias("depth"),
        F.when(counted, F.greatest("mipmap_count", F.lit(1))).otherwise(1).cast("long").alias("mipmap_count"),
        F.when(~mask & ~dx10, F.col("four_cc")).alias("four_cc"), "pf_flags",
        *(F.when(mask & ~dx10, F.col(c)).alias(c) for c in ("bits", "r_mask", "g_mask", "b_mask", "a_mask")),
        F.when(~dx10, F.col("caps2")).alias("caps2"), F.col("dxgi").cast("int").alias("dxgi"), F.col("resource_dim").cast("int").alias("resource_dim"),
        "misc", (array if lax else F.col("array_size")).alias("array_size"), F.when(dx10, F.when(alpha > 4, 0).otherwise(alpha)).cast("int").alias("alpha_mode"),
    )
    keep = {*own, "error"}
    return out.select(*(F.col(c) if c in keep else F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in out.columns))


def with_format(headers: DataFrame) -> DataFrame:
    """Adds the surface format (null if unsupported) and the size arithmetic, by left joins with the literal tables."""
    spark = headers.sparkSession
    dx = dims.dxgi(spark).select("dxgi", F.col("format").alias("dxgi_format"), *(F.col(c).alias(f"d_{c}") for c in layout.INFO))
    cc = dims.fourccs(spark).join(dims.dxgi(spark).select("dxgi", *layout.INFO), "dxgi", "left").drop("dxgi")
    plain = dims.formats(spark).select(F.col("format").alias("f"), *(F.col(c).alias(f"f_{c}") for c in layout.INFO))
    cc = cc.join(plain, F.col("format") == F.col("f"), "left").select("four_cc", F.col("format").alias("cc_format"), *(F.coalesce(c, f"f_{c}").alias(f"c_{c}") for c in layout.INFO))
    key = ["pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask"]
    # the first pattern that matches wins
    pattern = dims.masks(spark).groupBy(*key).agg(F.min_by("format", "pattern_no").alias("mask_format"))
    out = headers.join(F.broadcast(dx), "dxgi", "left").join(F.broadcast(cc), "four_cc", "left").join(F.broadcast(pattern), key, "left")
    premultiplied = F.when((F.col("alpha_mode") == 2) & (F.col("dxgi") == 74), "BC2_UNORM_PREMULTIPLIED_ALPHA").when((F.col("alpha_mode") == 2) & (F.col("dxgi") == 77), "BC3_UNORM_PREMULTIPLIED_ALPHA")
    # masks of any pattern have a size: the bit count
    by_bits = {"kind": F.lit("fixed"), "bytes": (F.col("bits") / 8).cast("int"), "block_w": F.lit(1), "block_h": F.lit(1), "plane1": F.lit(0), "plane2": F.lit(0), "sub_x": F.lit(1), "sub_y": F.lit(1)}
    info = [F.coalesce(f"d_{c}", f"c_{c}", F.when(F.col("bits").isNotNull(), by_bits[c])).alias(c) for c in layout.INFO]
    return out.select(*headers.columns, F.coalesce(premultiplied, "dxgi_format", "cc_format", "mask_format").alias("format"), *info)


def repair(headers: DataFrame, file_length: Column) -> DataFrame:
    """Permissive repair by the file's length: the first guess whose layout fills the data section; none leaves it as it is.

    Guesses, in order: as it is; array size 0 as 1 (kept even if nothing matches); array size 6 of a cube map as 1; mip
    counts 1, full, one less, one more. `headers` comes from `with_format`."""
    dx10, one = F.col("version") == "dx10", F.lit(1).cast("long")
    data = (file_length - F.when(dx10, 148).otherwise(128)).cast("long")
    was_zero = (F.col("array_size") == 0) & (data > 0)
    array = F.when(was_zero, one).otherwise(F.col("array_size"))
    cube = (F.col("array_size") == 6) & (F.col("resource_dim") == 3) & (F.col("misc").bitwiseAND(MISC_CUBE) != 0)
    mips, size = F.col("mipmap_count"), F.greatest("width", "height", F.coalesce("depth", one))
    guess = lambda a, m, ok, last=False: F.when(ok, F.struct(a.alias("a"), m.cast("long").alias("m"), F.lit(last).alias("last")))
    yes = F.lit(True)
    guesses = F.array_compact(F.array(
        guess(F.col("array_size"), mips, yes), guess(array, mips, was_zero), guess(one, mips, cube),
        guess(array, one, yes), guess(array, layout.full_mip_count(size), yes), guess(array, mips - 1, mips > 1), guess(array, mips + 1, yes), guess(array, mips, yes, last=True),
    ))
    # `with_layout` says what no guess changes; the elements of an array follow the guess
    laid = layout.with_layout(headers.withColumns({"_guesses": guesses, "_data": data}).withColumns({"array_size": F.when(dx10, one).otherwise(F.col("array_size")), "mipmap_count": one}))
    cubed, whole = F.col("layout_kind").isin("cube_maps", "partial_cube_map"), F.col("layout_kind") == "volume"
    count = lambda a: F.when(dx10 & ~whole, F.when(cubed, a * 6).otherwise(a)).otherwise(F.col("elements"))
    depth = F.when(whole, F.coalesce("depth", one)).otherwise(one)
    each = lambda m: layout.element_bytes(F.col("width"), F.col("layout_height"), depth, m)
    valid = F.col("layout_error").isNull()
    fits = lambda g: g.last | (valid & (g.m <= 255) & (count(g.a) < 2**32) & ((each(g.m) * count(g.a).cast("decimal(20,0)")).cast("decimal(38,0)") == F.col("_data")))
    first = laid.withColumn("_g", F.get(F.filter("_guesses", fits), F.lit(0)))
    return first.select(*(F.col(f"_g.{'a' if c == 'array_size' else 'm'}").alias(c) if c in ("array_size", "mipmap_count") else F.col(c) for c in headers.columns))


def to_words(headers: DataFrame, keep: list[str] = []) -> DataFrame:
    """Raw words of parsed headers (with format columns): pitch for fixed-size pixels, linear size for others, if they fit.

    `keep` names columns of `headers` that stay."""
    dx10 = F.col("version") == "dx10"
    pitch = F.col("width") * F.col("bytes")
    linear = layout.surface_bytes(F.col("width"), F.col("height"))
    fixed = F.col("kind") == "fixed"
    value = F.when(fixed, pitch.cast("decimal(38,0)")).otherwise(linear.cast("decimal(38,0)"))
    fits = value.isNotNull() & (value < 2**32)
    zero = F.lit(0).cast("long")
    bit = lambda cond, flag: F.when(cond, F.lit(flag)).otherwise(0).cast("long")
    flags = F.lit(F_CAPS | F_HEIGHT | F_WIDTH | F_PIXEL_FORMAT).cast("long") + bit(fits & fixed, F_PITCH) + bit(fits & ~fixed, F_LINEAR_SIZE) + bit(F.col("mipmap_count") >= 1, F_MIPMAP_COUNT) + bit(F.col("depth").isNotNull(), F_DEPTH)
    caps = F.lit(C_TEXTURE).cast("long") + bit(F.col("mipmap_count") > 1, C_COMPLEX | C_MIPMAP)
    cube = F.coalesce(F.col("misc").bitwiseAND(MISC_CUBE) != 0, F.lit(False))
    caps2 = F.when(dx10, bit(cube, C2_CUBE | C2_FACES) + bit(F.col("resource_dim") == 4, C2_VOLUME)).otherwise(F.coalesce("caps2", zero))
    four_cc = F.when(dx10, F.lit(DX10).cast("long")).otherwise(F.coalesce("four_cc", zero))
    pf_flags = F.when(four_cc != 0, F.lit(PF_FOURCC).cast("long")).otherwise(F.coalesce("pf_flags", zero))
    values = {
        "size": F.lit(124).cast("long"), "flags": flags, "height": F.col("height"), "width": F.col("width"), "pitch": F.when(fits, value.cast("long")).otherwise(0), "depth": F.coalesce("depth", F.lit(1).cast("long")),
        "mipmap_count": F.col("mipmap_count"), "pf_size": F.lit(32).cast("long"), "pf_flags": pf_flags, "four_cc": four_cc, "caps": caps, "caps2": caps2,
    } | {c: F.when(four_cc == 0, F.coalesce(c, zero)).otherwise(0) for c in ("bits", "r_mask", "g_mask", "b_mask", "a_mask")}
    extension = {"dxgi": F.col("dxgi").cast("long"), "resource_dim": F.col("resource_dim").cast("long"), "misc": F.col("misc"), "array_size": F.col("array_size"), "misc2": F.col("alpha_mode").cast("long")}
    return headers.select("file_id", *keep, *(values.get(w, zero).alias(w) for w in WORDS), *(F.when(dx10, extension[w]).alias(w) for w in DX10_WORDS), dx10.alias("has_dx10"))


def to_dx10(headers: DataFrame) -> DataFrame:
    """Legacy headers as extended ones: null dxgi where the pixel format has no code or the cube map is partial."""
    spark = headers.sparkSession
    cc = dims.fourccs(spark).select("four_cc", F.col("dxgi").alias("cc_dxgi"), F.col("format").alias("cc_fmt"))
    key = ["pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask"]
    pattern = dims.masks(spark).filter("dxgi is not null").groupBy(*key).agg(F.min_by("dxgi", "pattern_no").alias("mask_dxgi"))
    out = headers.join(F.broadcast(cc), "four_cc", "left").join(F.broadcast(pattern), key, "left")
    faces = F.coalesce(F.col("caps2").bitwiseAND(C2_FACES), F.lit(0).cast("long"))
    cube, volume = has("caps2", C2_CUBE), has("caps2", C2_VOLUME)
    premultiplied = F.col("cc_fmt").isin("BC2_UNORM_PREMULTIPLIED_ALPHA", "BC3_UNORM_PREMULTIPLIED_ALPHA")
    code = F.when(F.col("cc_fmt") == "BC2_UNORM_PREMULTIPLIED_ALPHA", 74).when(F.col("cc_fmt") == "BC3_UNORM_PREMULTIPLIED_ALPHA", 77).otherwise(F.coalesce("cc_dxgi", "mask_dxgi"))
    code = F.when(~(cube & (faces != C2_FACES)), code)
    return out.select(
        "file_id", "width", "height", "depth", "mipmap_count", code.cast("int").alias("dxgi"), F.when(volume, 4).otherwise(3).cast("int").alias("resource_dim"),
        F.when(cube, F.lit(MISC_CUBE)).otherwise(0).cast("long").alias("misc"), F.lit(1).cast("long").alias("array_size"), F.when(premultiplied, 2).otherwise(0).cast("int").alias("alpha_mode"),
    )


def to_dx9(headers: DataFrame) -> DataFrame:
    """Extended headers as legacy ones: FourCC or mask; convertible is false for arrays, cubes that are not 2-D, and unmapped codes."""
    spark = headers.sparkSession
    back = {}
    for code, name in dims.FOURCC_DXGI:  # the last code of a format is the one written
        if code not in ("ATI1", "ATI2"):
            back[dims.DXGI_CODE[name]] = dims.fourcc_number(code)
    cc = local_table(spark, list(back.items()), "dxgi int, out_four_cc long")
    pattern = dims.masks(spark).filter("dxgi is not null").groupBy("dxgi").agg(F.min_by(F.struct("pf_flags", "bits", "r_mask", "g_mask", "b_mask", "a_mask"), "pattern_no").alias("mask"))
    plain = dims.dxgi(spark).select("dxgi", F.col("linear").alias("lin"))
    keys = headers.join(F.broadcast(plain), "dxgi", "left").drop("dxgi").withColumnRenamed("lin", "dxgi")
    out = keys.join(F.broadcast(cc), "dxgi", "left").join(F.broadcast(pattern), "dxgi", "left")
    cube = F.col("misc").bitwiseAND(MISC_CUBE) != 0
    four = F.when((F.col("alpha_mode") == 2) & (F.col("dxgi") == 74), F.lit(dims.fourcc_number("DXT2"))).when((F.col("alpha_mode") == 2) & (F.col("dxgi") == 77), F.lit(dims.fourcc_number("DXT4"))).otherwise(F.col("out_four_cc"))
    ok = (F.col("array_size") == 1) & ~(cube & (F.col("resource_dim") != 3)) & (four.isNotNull() | F.col("mask").isNotNull())
    caps2 = F.when(cube, F.lit(C2_CUBE | C2_FACES)).when(F.col("resource_dim") == 4, F.lit(C2_VOLUME)).otherwise(0).cast("long")
    return out.select("file_id", ok.alias("convertible"), F.when(ok, four.cast("long")).alias("four_cc"), F.when(ok & four.isNull(), F.col("mask")).alias("mask"), F.when(ok, caps2).alias("caps2"))
