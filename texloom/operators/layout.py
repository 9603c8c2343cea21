"""Data layout of a texture file as rows: one row a surface, with its offset and length.

All are Column expressions over header columns; lengths are decimals, since a valid layout may exceed a signed 64-bit
number. Column names of the size arithmetic (INFO) are those of the `formats` and `dxgi` tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = ["kind", "bytes", "block_w", "block_h", "plane1", "plane2", "sub_x", "sub_y"]
LIMIT = "18446744073709551615"  # the longest length of the container
FACES = ["+X", "-X", "+Y", "-Y", "+Z", "-Z"]
_LEN = "decimal(38,0)"


def mip_size(size: Column, level: Column) -> Column:
    return F.greatest(F.when(level < 31, F.call_function("shiftright", size.cast("long"), level.cast("int"))).otherwise(F.lit(1).cast("long")), F.lit(1).cast("long"))


def full_mip_count(size: Column) -> Column:
    return F.length(F.bin(F.greatest(size, F.lit(1).cast("long")))).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    n = a + b - 1
    return ((n - F.pmod(n, b)) / b).cast("long")


def surface_bytes(width: Column, height: Column) -> Column:
    """Bytes of one surface under the row's INFO columns."""
    w, h = width.cast(_LEN), height.cast(_LEN)
    blocks = ceil_div(width, F.col("block_w")).cast(_LEN) * ceil_div(height, F.col("block_h")).cast(_LEN)
    samples = ceil_div(width, F.col("sub_x")).cast(_LEN) * ceil_div(height, F.col("sub_y")).cast(_LEN)
    planes = F.col("plane1") * (w * h).cast(_LEN) + F.col("plane2") * samples.cast(_LEN)
    return F.when(F.col("kind") == "fixed", (w * h).cast(_LEN) * F.col("bytes")).when(F.col("kind") == "block", blocks.cast(_LEN) * F.col("bytes")).otherwise(planes).cast(_LEN)


def _terms() -> Column:
    """What a surface's bytes are made of, once a row: a * ceil(w / p) * ceil(h / q) + b * ceil(w / r) * ceil(h / s)."""
    terms = lambda *values: F.struct(*((F.lit(v) if isinstance(v, int) else F.col(v)).cast("long").alias(n) for v, n in zip(values, "apqbrs", strict=True)))
    return F.when(F.col("kind") == "fixed", terms("bytes", 1, 1, 0, 1, 1)).when(F.col("kind") == "block", terms("bytes", "block_w", "block_h", 0, 1, 1)).otherwise(terms("plane1", 1, 1, "plane2", "sub_x", "sub_y"))


def _with_terms(of: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(_terms()), of), 0)


def _bytes_by(t: Column, width: Column, height: Column) -> Column:
    """As `surface_bytes`, in longs and of given terms: many times as fast, where the bytes fit a long."""
    up = lambda n, by: F.call_function("div", n + by - 1, by)
    first = t["a"] * up(width, t["p"]) * up(height, t["q"])
    return F.when(t["b"] == 0, first).otherwise(first + t["b"] * up(width, t["r"]) * up(height, t["s"]))


def element_bytes(width: Column, height: Column, depth: Column, mips: Column) -> Column:
    """Bytes of all mip levels of one element of an array: in longs, or in decimals where a long might overflow."""
    levels = F.sequence(F.lit(0), F.least(mips, F.lit(255).cast("long")).cast("int") - 1)
    small = (width < 1 << 24) & (height < 1 << 24) & (depth < 1 << 8)
    short = lambda t: F.aggregate(levels, F.lit(0).cast("long"), lambda a, k: a + _bytes_by(t, mip_size(width, k), mip_size(height, k)) * mip_size(depth, k))
    long = lambda a, k: (a + surface_bytes(mip_size(width, k), mip_size(height, k)) * mip_size(depth, k).cast("decimal(20,0)")).cast(_LEN)
    return F.when(small, _with_terms(short).cast(_LEN)).otherwise(F.aggregate(levels, F.lit(0).cast(_LEN), long))


def bits_per_pixel() -> Column:
    """Rounded up."""
    block = F.col("block_w") * F.col("block_h")
    per = F.col("sub_x") * F.col("sub_y")
    planes = F.col("plane1") * 8 + ceil_div(F.col("plane2") * 8, per)
    return F.when(F.col("kind") == "fixed", F.col("bytes") * 8).when(F.col("kind") == "block", ceil_div(F.col("bytes") * 8, block)).otherwise(planes).cast("int")


def with_layout(headers: DataFrame) -> DataFrame:
    """Adds layout_kind, elements (textures of the array), faces (the array of cube faces in order, if any), data_len and
    layout_error to headers that carry INFO columns."""
    dx10, cube10 = F.col("version") == "dx10", F.coalesce(F.col("misc").bitwiseAND(4) != 0, F.lit(False))
    cube9, volume9 = F.coalesce(F.col("caps2").bitwiseAND(0x200) != 0, F.lit(False)), F.coalesce(F.col("caps2").bitwiseAND(0x200000) != 0, F.lit(False))
    cube = F.when(dx10, cube10).otherwise(cube9)
    volume = F.when(dx10, F.col("resource_dim") == 4).otherwise(volume9)
    mask = F.call_function("shiftright", F.coalesce("caps2", F.lit(0).cast("long")), F.lit(10)).bitwiseAND(63)
    faces9 = F.filter(F.array(*(F.when(mask.bitwiseAND(1 << i) != 0, F.lit(f)) for i, f in enumerate(FACES))), lambda x: x.isNotNull())
    faces = F.when(cube & dx10, F.array(*map(F.lit, FACES))).when(cube, faces9)
    one = F.lit(1).cast("long")
    elements = F.when(cube & dx10, F.col("array_size") * 6).when(cube, F.size(faces9).cast("long")).when(dx10 & ~volume, F.col("array_size")).otherwise(one)
    kind = F.when(cube, F.when(dx10 | (F.size(faces9) == 6), "cube_maps").otherwise("partial_cube_map")).when(volume, "volume").when(elements == 1, "texture").otherwise("textures")
    height = F.when(dx10 & (F.col("resource_dim") == 2), one).otherwise(F.col("height"))
    depth = F.when(volume, F.coalesce("depth", one)).otherwise(one)
    each = element_bytes(F.col("width"), height, depth, F.col("mipmap_count"))
    total = (F.col("element_len") * F.col("elements").cast("decimal(20,0)")).cast(_LEN)
    zero = (F.col("width") == 0) | (F.col("height") == 0) | (volume & (F.col("depth") == 0))
    bad_cube = F.when(dx10, cube10 & (F.col("resource_dim") != 3)).otherwise(cube9 & volume9)
    error = (
        F.when(F.col("kind").isNull(), "UnsupportedPixelFormat")
        .when(bad_cube, "InvalidCubeMapFaces")
        .when((F.col("width") == 0) | (F.col("height") == 0), "ZeroDimension")
        .when(volume & F.col("depth").isNull(), "MissingDepth")
        .when(zero, "ZeroDimension")
        .when(F.col("mipmap_count") > 255, "TooManyMipMaps")
        .when(cube & dx10 & (F.col("array_size") * 6 >= 2**32), "ArraySizeTooBig")
        .when(F.coalesce(total, F.lit(LIMIT).cast(_LEN) + 1) > F.lit(LIMIT).cast(_LEN), "DataLayoutTooBig")
    )
    out = headers.withColumns({"layout_kind": kind, "elements": elements, "faces": faces, "layout_height": height})
    # a list of one, exploded: neither the columns below nor filters on them make the sum over the levels anew
    out = out.drop("element_len").select("*", F.explode(F.array(each)).alias("element_len")).withColumn("data_len", total).withColumn("layout_error", error)
    return out.withColumn("data_len", F.when(F.col("layout_error").isNull(), F.col("data_len")))


#: Files of fewer bytes are laid out in longs.
_LONGS = 1 << 62


def _levels() -> Column:
    """The levels of a file's elements, made once a file: size, bytes of a slice, bytes and surfaces before, in longs where
    `_small`, else bytes as decimals (big_...)."""
    zero, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast(_LEN)
    levels, width, height = F.sequence(F.lit(0), F.col("mipmap_count").cast("int") - 1), F.col("width"), F.col("layout_height")
    deep = lambda k: F.when(F.col("layout_kind") == "volume", mip_size(F.coalesce("depth", one), k)).otherwise(one)
    level = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, ("level", "w", "h", "d", "n", "before", "first", "big_n", "big_before"), strict=True)))
    size = lambda t, k: F.struct(k.alias("level"), mip_size(width, k).alias("w"), mip_size(height, k).alias("h"), deep(k).alias("d"), _bytes_by(t, mip_size(width, k), mip_size(height, k)).alias("n"))
    sized = _with_terms(lambda t: F.transform(levels, lambda k: size(t, k)))

    def put(x: Column, of: Column) -> Column:
        earlier = F.slice(of, F.lit(1), x["level"])
        before = F.aggregate(earlier, zero, lambda a, y: a + y["n"] * y["d"])
        first = F.when(F.col("layout_kind") == "volume", F.aggregate(earlier, zero, lambda a, y: a + y["d"])).otherwise(x["level"].cast("long"))
        return level(x["level"], x["w"], x["h"], x["d"], x["n"], before, first, none, none)

    def big(k: Column) -> Column:
        earlier = F.slice(levels, F.lit(1), k)
        n = lambda j: surface_bytes(mip_size(width, j), mip_size(height, j))
        before = F.aggregate(earlier, F.lit(0).cast(_LEN), lambda a, j: (a + n(j) * deep(j).cast("decimal(20,0)")).cast(_LEN))
        return level(k, mip_size(width, k), mip_size(height, k), deep(k), F.lit(None).cast("long"), F.lit(None).cast("long"), F.aggregate(earlier, zero, lambda a, j: a + deep(j)), n(k), before)

    return F.when(F.col("_small"), F.get(F.transform(F.array(sized), lambda of: F.transform(of, lambda x: put(x, of))), 0)).otherwise(F.transform(levels, big))


def _spread(laid: DataFrame, keep: list[str]) -> DataFrame:
    """One row a surface: array_index, depth_slice, _l (its level), _at (offset in longs, null in huge files) and the columns kept."""
    ok = laid.filter("layout_error is null")
    own = ["file_id", "layout_kind", "width", "layout_height", "depth", "faces", "element_len", "elements", *(c for c in keep if c not in INFO), *INFO]
    small = (F.col("element_len") < _LONGS) & (F.col("data_len") < _LONGS)
    rows = ok.select(*own, "mipmap_count", small.alias("_small")).filter("elements > 0")
    rows = rows.select(*own, F.when(F.col("_small"), F.col("element_len").cast("long")).alias("_each_len"), F.explode(_levels()).alias("_l"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("elements") - 1)).alias("array_index"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_l.d") - 1)).alias("depth_slice"))
    return rows.withColumn("_at", F.col("array_index") * F.col("_each_len") + F.col("_l.before") + F.col("depth_slice") * F.col("_l.n"))


def _offset() -> Column:
    big = F.col("array_index").cast("decimal(20,0)") * F.col("element_len").cast("decimal(20,0)") + F.col("_l.big_before") + F.col("depth_slice").cast("decimal(20,0)") * F.col("_l.big_n").cast("decimal(20,0)")
    return F.when(F.col("_at").isNotNull(), F.col("_at").cast("decimal(20,0)")).otherwise(big.cast("decimal(20,0)"))


def surfaces(laid: DataFrame, keep: list[str] = []) -> DataFrame:
    """One row a surface, in scan order: element by element, level by level, slice by slice. An empty array has none.

    `keep` names columns of `laid` that stay."""
    face = F.when(F.col("faces").isNotNull(), F.get("faces", F.pmod(F.col("array_index"), F.size("faces")).cast("int")))
    size = F.coalesce(F.col("_l.n").cast("decimal(20,0)"), F.col("_l.big_n").cast("decimal(20,0)"))
    return _spread(laid, keep).select("file_id", F.col("layout_kind").alias("kind"), "array_index", face.alias("face"), F.col("_l.level").alias("mip_level"), "depth_slice", F.col("_l.w").alias("width"), F.col("_l.h").alias("height"), _offset().alias("offset"), size.alias("len"), *keep)


def missing_surfaces(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Expected and written surfaces that do not meet: missing, unexpected, or of another size (status)."""
    key = ["file_id", "array_index", "mip_level", "depth_slice"]
    e, w = expected.select(*key, F.col("width").alias("ew"), F.col("height").alias("eh")), written.select(*key, F.col("width").alias("ww"), F.col("height").alias("wh"))
    both = e.join(w, key, "full")
    status = F.when(F.col("ww").isNull(), "MissingSurfaces").when(F.col("ew").isNull(), "TooManySurfaces").when((F.col("ew") != F.col("ww")) | (F.col("eh") != F.col("wh")), "UnexpectedSurfaceSize")
    return both.select(*key, status.alias("status")).filter("status is not null")


def cursor(laid: DataFrame, keep: list[str] = []) -> DataFrame:
    """The surfaces in scan order as places of a cursor: ordinal (from 0), count, elapsed bytes, and where each move leads.

    previous and next are the ordinals that rewinding and skipping a surface lead to (null before the first and behind the
    last). skip_to and skip_bytes belong to skipping the rest of the mip levels: nothing at level 0, else to the next element
    (count stands for the end). Within a level of a volume that is an error (skip_error). All are closed forms of the header,
    so there is no window over a file's surfaces."""
    one, levels = F.lit(1).cast("long"), F.sequence(F.lit(0), F.col("mipmap_count").cast("int") - 1)
    each = F.when(F.col("layout_kind") == "volume", F.aggregate(levels, F.lit(0).cast("long"), lambda a, k: a + mip_size(F.coalesce("depth", one), k))).otherwise(F.size(levels).cast("long"))
    rows = _spread(laid.withColumn("_each", each), [*keep, "_each"])
    face = F.when(F.col("faces").isNotNull(), F.get("faces", F.pmod(F.col("array_index"), F.size("faces")).cast("int")))
    size = F.coalesce(F.col("_l.n").cast("decimal(20,0)"), F.col("_l.big_n").cast("decimal(20,0)"))
    end = F.when(F.col("_at").isNotNull(), (F.col("array_index") + 1) * F.col("_each_len")).otherwise(((F.col("array_index") + 1).cast("decimal(20,0)") * F.col("element_len").cast("decimal(20,0)")).cast("decimal(38,0)").cast("long"))
    rows = rows.select(
        "file_id", F.col("layout_kind").alias("kind"), "array_index", face.alias("face"), F.col("_l.level").alias("mip_level"), "depth_slice", F.col("_l.w").alias("width"), F.col("_l.h").alias("height"), _offset().alias("offset"), size.alias("len"), *keep,
        (F.col("array_index") * F.col("_each") + F.col("_l.first") + F.col("depth_slice")).alias("ordinal"), (F.col("elements") * F.col("_each")).alias("count"), F.coalesce("_at", _offset().cast("long")).alias("elapsed"), end.alias("_end"), "_each",
    )
    error = F.when((F.col("kind") == "volume") & (F.col("depth_slice") > 0), "CannotSkipMipmapsInVolume")
    moved = F.col("mip_level") > 0
    return rows.withColumns({
        "previous": F.when(F.col("ordinal") > 0, F.col("ordinal") - 1), "next": F.when(F.col("ordinal") + 1 < F.col("count"), F.col("ordinal") + 1), "skip_error": error,
        "skip_bytes": F.when(error.isNull(), F.when(moved, F.col("_end") - F.col("elapsed")).otherwise(0)), "skip_to": F.when(error.isNull(), F.when(moved, (F.col("array_index") + 1) * F.col("_each")).otherwise(F.col("ordinal"))),
    }).drop("_each", "_end")
