"""BC7 decoding as Column arithmetic over units (functions/units.py): all eight modes in one projection.

What a mode says (subsets, widths) is picked from literal arrays once a block; the place of every field follows from it, and
each of the 16 pixels reads its end points, its indices and their weights from the two words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texloom.functions import bc_tables

_PARTS = ["subsets", "partition_bits", "rotation_bits", "switch_bits", "colour_bits", "alpha_bits", "p_kind", "index_bits", "second_bits"]


def _shift(x: Column, n: Column, left: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", x, n.cast("int"))


def _bits(at: Column, n: Column) -> Column:
    """n bits (at most 16) from a place after the first of the 128 bits."""
    both = _shift(F.col("lo"), at).bitwiseOR(_shift(F.col("hi"), 64 - at, True))
    return F.when(at >= 64, _shift(F.col("hi"), at - 64)).otherwise(both).bitwiseAND(_shift(F.lit(1).cast("long"), F.greatest(n, F.lit(0)), True) - 1)


def _table(values: list[int], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index.cast("int"))


def _subsets(rows: list[str]) -> list[int]:
    """Two bits for each pixel."""
    return [sum(int(c) << (2 * i) for i, c in enumerate(row)) for row in rows]


def _weight(index: Column, width: Column) -> Column:
    tables = {n: _table(list(w), index) for n, w in bc_tables.WEIGHTS.items()}
    return F.when(width == 2, tables[2]).when(width == 3, tables[3]).otherwise(tables[4])


def mode_of(lo: Column) -> Column:
    """The lowest bit set of the first byte; 8 for the reserved mode."""
    out = F.lit(8)
    for mode in range(7, -1, -1):
        out = F.when(lo.bitwiseAND(1 << mode) != 0, F.lit(mode)).otherwise(out)
    return out


def pixels(units: DataFrame) -> DataFrame:
    """The rows of `units` sixteen times, with pixel (0 to 15, row by row), r, g, b and a; the reserved mode is all zero."""
    own = [c for c in units.columns if c not in ("lo", "hi")]
    col = F.col
    modes = units.withColumn("mode", mode_of(col("lo")))
    modes = modes.withColumns({c: F.coalesce(_table([m[i] for m in bc_tables.BC7_MODES], col("mode")), F.lit(0).cast("long")) for i, c in enumerate(_PARTS)})
    first = col("mode") + 1
    heads = modes.withColumns({
        "partition": _bits(first, col("partition_bits")), "rotation": _bits(first + col("partition_bits"), col("rotation_bits")),
        "switch": _bits(first + col("partition_bits") + col("rotation_bits"), col("switch_bits")), "ends_at": first + col("partition_bits") + col("rotation_bits") + col("switch_bits"),
    })
    heads = heads.withColumn("p_at", col("ends_at") + col("subsets") * (6 * col("colour_bits") + 2 * col("alpha_bits")))
    heads = heads.withColumns({
        "index_at": col("p_at") + F.when(col("p_kind") == 1, 2 * col("subsets")).when(col("p_kind") == 2, col("subsets")).otherwise(0),
        "map": F.when(col("subsets") == 2, _table(_subsets(bc_tables.TWO), col("partition"))).when(col("subsets") == 3, _table(_subsets(bc_tables.THREE), col("partition"))).otherwise(0),
        "fix1": F.when(col("subsets") == 2, _table(bc_tables.FIX_TWO, col("partition"))).when(col("subsets") == 3, _table([f[0] for f in bc_tables.FIX_THREE], col("partition"))).otherwise(0),
        "fix2": F.when(col("subsets") == 3, _table([f[1] for f in bc_tables.FIX_THREE], col("partition"))).otherwise(0),
    })
    spread = heads.withColumn("pixel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    p, zero = col("pixel"), F.lit(0).cast("long")
    before = lambda fix: F.when((fix > 0) & (fix < p), 1).otherwise(0)
    implied = F.when((p == 0) | ((col("fix1") > 0) & (p == col("fix1"))) | ((col("fix2") > 0) & (p == col("fix2"))), 1).otherwise(0)
    skipped = F.when(p > 0, 1).otherwise(0) + before(col("fix1")) + before(col("fix2"))
    spread = spread.withColumns({"s": _shift(col("map"), 2 * p).bitwiseAND(3), "implied": implied, "skipped": skipped})
    one = _bits(col("index_at") + p * col("index_bits") - col("skipped"), col("index_bits") - col("implied"))
    second_at = col("index_at") + 16 * col("index_bits") - col("subsets")
    two = _bits(second_at + p * col("second_bits") - col("skipped"), F.greatest(col("second_bits") - col("implied"), zero))
    ends = {}
    for i, c in enumerate("rgba"):
        width = col("alpha_bits") if c == "a" else col("colour_bits")
        start = col("ends_at") + (6 * col("subsets") * col("colour_bits") if c == "a" else 2 * i * col("subsets") * col("colour_bits"))
        for e in (0, 1):
            ends[f"{c}{e}"] = _bits(start + (2 * col("s") + e) * width, width)
    ends |= {f"p{e}": F.when(col("p_kind") == 0, zero).otherwise(_bits(col("p_at") + F.when(col("p_kind") == 2, col("s")).otherwise(2 * col("s") + e), F.lit(1))) for e in (0, 1)}
    spread = spread.withColumns({"w1": _weight(one, col("index_bits")), "w2": F.when(col("second_bits") > 0, _weight(two, col("second_bits"))), **ends})
    turned = (col("second_bits") > 0) & (col("switch") == 1)
    colour_weight = F.when(turned, col("w2")).otherwise(col("w1"))
    alpha_weight = F.when((col("second_bits") == 0) | turned, col("w1")).otherwise(col("w2"))
    spread = spread.withColumns({"wc": colour_weight, "wa": alpha_weight})

    def raised(c: str, e: int) -> Column:
        """An end point with its shared bit, widened to 8 bits by its own high bits."""
        more = F.when(col("p_kind") > 0, 1).otherwise(0)
        width = (col("alpha_bits") if c == "a" else col("colour_bits")) + more
        v = _shift(F.when(col("p_kind") > 0, col(f"{c}{e}") * 2 + col(f"p{e}")).otherwise(col(f"{c}{e}")), 8 - width, True)
        v = v.bitwiseOR(_shift(v, width))
        return F.when(col("alpha_bits") == 0, 255).otherwise(v) if c == "a" else v

    mixed = {f"m{c}": _shift((64 - col("wa" if c == "a" else "wc")) * raised(c, 0) + col("wa" if c == "a" else "wc") * raised(c, 1) + 32, F.lit(6)) for c in "rgba"}
    spread = spread.withColumns(mixed)
    known = lambda x: F.when(col("mode") == 8, zero).otherwise(x).cast("long")
    colours = [known(F.when(col("rotation") == i + 1, col("ma")).otherwise(col(f"m{c}"))).alias(c) for i, c in enumerate("rgb")]
    alpha = F.when(col("rotation") == 1, col("mr")).when(col("rotation") == 2, col("mg")).when(col("rotation") == 3, col("mb")).otherwise(col("ma"))
    return spread.select(*own, "pixel", *colours, known(alpha).alias("a"))
