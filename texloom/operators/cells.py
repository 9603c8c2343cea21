"""Work within 4 x 4 blocks held as arrays of 16, row by row: local error diffusion, stable partition, sets of colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a set of colour kinds: channels and precision, in this order.
CHANNELS, PRECISIONS = ["grayscale", "alpha", "rgb", "rgba"], ["u8", "u16", "f32"]


def diffusion_weights() -> list[list[int]]:
    """Sixteenths of a pixel's error that go to each of the 16 pixels of its block.

    Floyd and Steinberg's shares; where a neighbour is missing, those left over take more. In the last column a quarter of the
    error is lost, in the last row half of it."""
    out = []
    for i in range(16):
        y, x = divmod(i, 4)
        right, below = 7, {-1: 3, 0: 5, 1: 1}
        if x == 0:
            below = {-1: 0, 0: 6, 1: 2}
        if x == 3:
            below = {-1: 5, 0: 7, 1: 0}
        if y == 3:
            right, below = 8, {-1: 0, 0: 0, 1: 0}
        row = [0] * 16
        if x < 3:
            row[i + 1] = right
        for dx, share in below.items():
            if y < 3 and 0 <= x + dx < 4:
                row[i + 4 + dx] = share
        out.append(row)
    return out


def block_arrays(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys and `cell`: the values of a block in the order of its pixels (`i`, 0 to 15)."""
    found = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value))).alias("cell"))
    return found.withColumn("cell", F.transform("cell", lambda p: p[value].cast("double")))


def value_palette(cell: Column) -> Column:
    """The eight values of a BC4 block between its extremes: largest, smallest, then six steps down."""
    high, low = F.array_max(cell), F.array_min(cell)
    return F.array(high, low, *((high * float(7 - k) + low * float(k)) / 7.0 for k in range(1, 7)))


def diffused_codes(cell: Column, palette: Column) -> Column:
    """The palette index of each pixel, errors carried on within the block: 16 steps of one `aggregate`.

    Each error is added to the pixels' values as it arises, in this order, as sums of doubles depend on it. The nearest entry is taken, ties by the smaller index. `palette` and `cell` are arrays of doubles; null gives null."""
    weights = F.array(*(F.array(*(F.lit(w / 16) for w in row)) for row in diffusion_weights()))
    start = F.struct(cell.alias("cell"), F.array().cast("array<int>").alias("codes"))

    def bound(x: Column, of) -> Column:
        return F.get(F.transform(F.array(x), of), 0)

    def step(state: Column, i: Column) -> Column:
        value = F.get(state["cell"], i)

        def chosen(v: Column) -> Column:
            nearest = F.array_min(F.transform(palette, lambda p, k: F.struct(((v - p) * (v - p)).alias("distance"), k.alias("index"))))["index"]
            return F.struct(v.alias("value"), nearest.alias("index"))

        def carried(c: Column) -> Column:
            error = c["value"] - F.get(palette, c["index"])
            values = F.transform(state["cell"], lambda v, k: v + error * F.get(F.get(weights, i), k))
            return F.struct(values.alias("cell"), F.concat(state["codes"], F.array(c["index"])).alias("codes"))

        return bound(bound(value, chosen), carried)

    return F.aggregate(F.sequence(F.lit(0), F.lit(15)), start, step, lambda state: state["codes"])


def sorted_by_subset(cell: Column, subsets: Column, n: int = 3) -> Column:
    """Stable partition: a block's values subset by subset, each in its own order. `subsets` is an array of 16 numbers below n."""
    one = lambda s: F.filter(cell, lambda _, i: F.get(subsets, i) == s)
    return F.concat(*(one(s) for s in range(n)))


def colour_bit(channels: Column, precision: Column) -> Column:
    """The set of one colour kind, as a bit; unions are `bit_or`, intersections `bit_and`, sizes `bit_count`."""
    at = lambda names, x: F.array_position(F.array(*(F.lit(n) for n in names)), F.lower(x)) - 1
    return F.call_function("shiftleft", F.lit(1).cast("long"), (at(CHANNELS, channels) * 3 + at(PRECISIONS, precision)).cast("int"))
