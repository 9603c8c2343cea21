"""BC6H decoding as Column arithmetic over units (functions/units.py).

A mode is a row of a table: for each of the twelve end point numbers the places of its bits in the block. The table is joined
with each block's mode, numbers are gathered bit by bit, and what follows is arithmetic on longs: sign extension, deltas,
unquantising, mixing, and the half that comes out, shown as the 32 bits of its single-precision number.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.functions import bc_tables
from texloom.functions.local import local_table
from texloom.operators.bc7 import _bits, _shift, _subsets, _table, _weight

NUMBERS = [c + e for e in "wxyz" for c in "rgb"]


def mode_places(line: str) -> tuple[int, int, tuple[int, int, int], bool, dict[str, list[int]]]:
    """Mode bits, bits of the first end point and of the deltas, whether there are deltas, and the places of each number's bits."""
    mode, base, *deltas, moved = map(int, line.split()[:6])
    at, places = 2 if mode < 2 else 5, {n: [] for n in NUMBERS}
    for name, low, high in re.findall(r"([rgb][wxyz])(\d+)(?:\.\.(\d+))?", line):
        first, last = int(low), int(high or low)
        for bit in range(first, last + 1) if first <= last else range(first, last - 1, -1):
            row = places[name]
            row += [0] * (bit + 1 - len(row))
            row[bit] = at
            at += 1
    return mode, base, tuple(deltas), bool(moved), places


def modes_table(spark: SparkSession) -> DataFrame:
    """A row for each of the 14 modes. No bit of a number lies at place 0, which stands for none."""
    rows = []
    for mode, base, deltas, moved, places in map(mode_places, bc_tables.BC6_MODES):
        rows.append((mode, base, list(deltas), moved, 1 if mode in (3, 7, 11, 15) else 2, [places[n] for n in NUMBERS]))
    return local_table(spark, rows, "_mode long, _base int, _deltas array<int>, _moved boolean, _subsets int, _places array<array<int>>")


def _extended(v: Column, n: Column) -> Column:
    """A two's complement number of n bits."""
    half = _shift(F.lit(1).cast("long"), n - 1, True)
    return F.when(v >= half, v - 2 * half).otherwise(v)


def _unquantised(v: Column, bits: Column, signed: bool) -> Column:
    one = F.lit(1).cast("long")
    if not signed:
        top = _shift(one, bits, True) - 1
        return F.when((bits >= 15) | (v == 0), v).when(v == top, 0xFFFF).otherwise(_shift(v * 65536 + 0x8000, bits))
    size, top = F.abs(v), _shift(one, bits - 1, True) - 1
    wide = F.when(size == 0, 0).when(size >= top, 0x7FFF).otherwise(_shift(size * 32768 + 0x4000, bits - 1))
    return F.when(bits >= 16, v).otherwise(F.when(v < 0, -wide).otherwise(wide))


def pixels(units: DataFrame, signed: bool) -> DataFrame:
    """The rows of `units` sixteen times, with pixel (0 to 15, row by row), r, g and b; reserved modes are all zero."""
    from texloom.operators.packed import small_float_bits

    own, col = [c for c in units.columns if c not in ("lo", "hi")], F.col
    low2 = col("lo").bitwiseAND(3)
    mode = F.when(low2 < 2, low2).otherwise(col("lo").bitwiseAND(31))
    blocks = units.withColumn("_mode", mode).join(F.broadcast(modes_table(units.sparkSession)), "_mode", "left")
    bit = lambda at: F.when(at == 0, 0).when(at >= 64, _shift(col("hi"), at - 64)).otherwise(_shift(col("lo"), at)).cast("long").bitwiseAND(1)
    number = lambda i: F.aggregate(F.transform(col("_places")[i], lambda at, k: _shift(bit(at), k, True)), F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = blocks.withColumns({f"_{n}": number(i) for i, n in enumerate(NUMBERS)}).drop("_places")
    mask = _shift(F.lit(1).cast("long"), col("_base"), True) - 1
    steps: list[dict[str, Column]] = [{}, {}, {}]  # in projections of their own, so that each stays small
    for k, c in enumerate("rgb"):
        if signed:
            steps[0][f"_{c}w"] = _extended(col(f"_{c}w"), col("_base"))
        for e in "xyz":
            v = _extended(col(f"_{c}{e}"), col("_deltas")[k])
            steps[0][f"_{c}{e}"] = v if signed else F.when(col("_moved"), v).otherwise(col(f"_{c}{e}"))
            moved = (col(f"_{c}{e}") + col(f"_{c}w")).bitwiseAND(mask)
            steps[1][f"_{c}{e}"] = F.when(col("_moved"), _extended(moved, col("_base")) if signed else moved).otherwise(col(f"_{c}{e}"))
        steps[2] |= {f"_{c}{e}": _unquantised(col(f"_{c}{e}"), col("_base"), signed) for e in "wxyz"}
    for step in steps:
        blocks = blocks.withColumns(step)
    two = col("_subsets") == 2
    partition = _bits(F.lit(77), F.lit(5))
    blocks = blocks.withColumns({"_map": F.when(two, _table(_subsets(bc_tables.TWO), partition)).otherwise(0), "_fix": F.when(two, _table(bc_tables.FIX_TWO, partition)).otherwise(0)})
    spread = blocks.withColumn("pixel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    p = col("pixel")
    width = F.when(two, 3).otherwise(4)
    fixed = (p == 0) | (two & (p == col("_fix")))
    skipped = F.when(p > 0, 1).otherwise(0) + F.when(two & (col("_fix") < p), 1).otherwise(0)
    index = _bits(F.when(two, 82).otherwise(65) + p * width - skipped, width - F.when(fixed, 1).otherwise(0))
    spread = spread.withColumns({"_w": _weight(index, width), "_second": two & (_shift(col("_map"), 2 * p).bitwiseAND(3) == 1)})

    def half(c: str) -> Column:
        a, b = (F.when(col("_second"), col(f"_{c}{y}")).otherwise(col(f"_{c}{x}")) for x, y in (("w", "y"), ("x", "z")))
        v = F.call_function("shiftright", a * (64 - col("_w")) + b * col("_w") + 32, F.lit(6))
        if not signed:
            return _shift(v * 31, F.lit(6))
        size = _shift(F.abs(v) * 31, F.lit(5))
        return F.when((v < 0) & (size > 0), size + 0x8000).otherwise(size)

    known = lambda c: F.when(two.isNull(), F.lit(0).cast("long")).otherwise(small_float_bits(half(c), F.lit(16)))
    return spread.select(*own, "pixel", *(known(c).cast("long").alias(c) for c in "rgb"))
