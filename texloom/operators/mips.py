"""Mip chains with filters: a separable resample as two joins with a table of weights, level by level.

A target pixel is the weighted mean of the source pixels under the filter, which is as wide as a target pixel where the image
shrinks. The weights of a line depend on its two lengths only, so they are a table (src, dst, source, target, weight), made
once for the sizes that occur; columns and then rows of a surface are joined with it and summed. Sums are partial before
each shuffle, and no task holds a surface.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.operators.layout import mip_size

#: Half the width of each filter.
SUPPORT = {"nearest": 0.0, "box": 0.5, "triangle": 1.0, "mitchell": 2.0, "lanczos3": 3.0}
#: A table of weights is broadcast up to so many rows.
BROADCAST_WEIGHTS = 1_000_000
#: Alpha below this share of one counts as none.
NO_ALPHA = 1e-6


def kernel(filter: str, x: Column) -> Column:
    """The filter's value at a distance in target pixels."""
    d = F.abs(x)
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * pi) / (v * pi))
    if filter == "box":
        return F.when((x > -0.5) & (x <= 0.5), 1.0).otherwise(0.0)
    if filter == "triangle":
        return F.greatest(1 - d, F.lit(0.0))
    if filter == "mitchell":  # B and C of one third
        near, far = (7 * d * d * d - 12 * d * d + 16 / 3) / 6, (-7 / 3 * d * d * d + 12 * d * d - 20 * d + 32 / 3) / 6
        return F.when(d < 1, near).when(d < 2, far).otherwise(0.0)
    return F.when(d < 3, sinc(d) * sinc(d / 3)).otherwise(0.0)


def weights(sizes: DataFrame, filter: str) -> DataFrame:
    """src, dst, source, target, weight of lines resampled from `src` to `dst` pixels; the weights of a target sum to one."""
    targets = sizes.select("src", "dst").distinct().withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dst") - 1)))
    ratio = F.col("src") / F.col("dst")
    centre, scale = (F.col("target") + 0.5) * ratio, F.greatest(ratio, F.lit(1.0))
    last = F.col("src") - 1
    if filter == "nearest":
        return targets.select("src", "dst", F.least(F.floor(centre), last).alias("source"), "target", F.lit(1.0).alias("weight"))
    reach = scale * SUPPORT[filter]
    low, high = F.greatest(F.ceil(centre - reach - 0.5), F.lit(0).cast("long")), F.least(F.floor(centre + reach - 0.5), last)
    each = targets.withColumns({"_c": centre, "_s": scale}).withColumn("source", F.explode(F.sequence(low, F.greatest(low, high))))
    raw = each.withColumn("weight", kernel(filter, (F.col("source") + 0.5 - F.col("_c")) / F.col("_s"))).filter("weight <> 0")
    total = raw.groupBy("src", "dst", F.col("target").alias("t")).agg(F.sum("weight").alias("total"))
    out = raw.join(total.withColumnsRenamed({"src": "_src", "dst": "_dst"}), (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")) & (F.col("target") == F.col("t")))
    return out.select("src", "dst", "source", "target", (F.col("weight") / F.col("total")).alias("weight"))


def _line(pixels: DataFrame, table: DataFrame, along: str, size: str, to: str, across: str, channels: list[str], key: list[str]) -> DataFrame:
    """One direction: `along` runs over `size` pixels and then over `to`."""
    own = table.select(F.col("src").alias(size), F.col("dst").alias(to), F.col("source").alias(along), F.col("target").alias("_t"), "weight")
    both = pixels.join(own, [size, to, along])
    keep = [*key, "width", "height", "_w", "_h"]
    return both.groupBy(*keep, F.col("_t").alias(along), across).agg(*(F.sum(F.col(c) * F.col("weight")).alias(c) for c in channels))


def resampled(pixels: DataFrame, width: Column, height: Column, filter: str, key: list[str], channels: list[str], straight_alpha: bool = False, top: int | None = 255) -> DataFrame:
    """`pixels` (key, width, height, x, y and the channels) at another size, in whole numbers up to `top`, or reals for None.

    With straight alpha the colours are weighted by the channel `a`, so that what is transparent does not bleed."""
    rows = pixels.withColumns({"_w": width.cast("long"), "_h": height.cast("long")} | {c: F.col(c).cast("double") for c in channels})
    colours = [c for c in channels if c != "a"] if straight_alpha else []
    rows = rows.withColumns({c: F.col(c) * F.col("a") for c in colours})
    across, down = (weights(rows.select(F.col(a).alias("src"), F.col(b).alias("dst")), filter) for a, b in (("width", "_w"), ("height", "_h")))
    across, down = (F.broadcast(t) if t.count() <= BROADCAST_WEIGHTS else t for t in (across, down))
    wide = _line(rows, across, "x", "width", "_w", "y", channels, key)
    out = _line(wide, down, "y", "height", "_h", "x", channels, key)
    out = out.withColumns({c: F.when(F.col("a") > NO_ALPHA * (top or 1), F.col(c) / F.col("a")).otherwise(0.0) for c in colours})
    if top is not None:
        # a sum that is a half but for the last bits of its order is a half
        out = out.withColumns({c: F.least(F.greatest(F.floor(F.round(c, 9) + 0.5), F.lit(0)), F.lit(top)).cast("long") for c in channels})
    return out.select(*key, F.col("_w").alias("width"), F.col("_h").alias("height"), "x", "y", *channels)


def chain(pixels: DataFrame, levels: int, filter: str, key: list[str], channels: list[str], straight_alpha: bool = False, cut=lambda frame: frame) -> DataFrame:
    """All mip levels from 0 on, each made from the one before it: adds mip_level. A surface's chain ends with its 1 x 1 level.

    `cut` may write a level to a table before the next is made from it."""
    level = pixels.select(*key, "width", "height", "x", "y", *channels)
    out = level.withColumn("mip_level", F.lit(0))
    for k in range(1, levels):
        left = level.filter("width > 1 or height > 1")
        one = F.lit(1)
        level = cut(resampled(left, mip_size(F.col("width"), one), mip_size(F.col("height"), one), filter, key, channels, straight_alpha))
        out = out.unionByName(level.withColumn("mip_level", F.lit(k)))
    return out
