"""Layouts of small and huge files against a plain loop, and how often a plan makes a file's sums."""

import re

from pyspark.sql import functions as F

from texloom.operators import layout

#: kind, bytes, block_w, block_h, plane1, plane2, sub_x, sub_y
KINDS = [("fixed", 4, 1, 1, 0, 0, 1, 1), ("block", 8, 4, 4, 0, 0, 1, 1), ("biplanar", 0, 0, 0, 2, 4, 2, 2)]
#: width, height, depth, mipmap_count, array_size, resource_dim
SHAPES = [(7, 5, None, 3, 2, 3), (9, 6, 5, 4, 1, 4), (1 << 24, 3, None, 25, 3, 3), ((1 << 31) + 5, (1 << 29) + 3, None, 32, 2, 3), (1 << 28, 1 << 27, 300, 3, 1, 4), (3, 2, None, 1, 0, 3)]


def headers(spark):
    rows = [(i, "dx10", *shape, *kind) for i, (shape, kind) in enumerate((s, k) for s in SHAPES for k in KINDS)]
    named = "file_id long, version string, width long, height long, depth long, mipmap_count long, array_size long, resource_dim int, kind string, bytes int, block_w int, block_h int, plane1 int, plane2 int, sub_x int, sub_y int"
    return rows, spark.createDataFrame(rows, named).withColumns({"misc": F.lit(0).cast("long"), "caps2": F.lit(None).cast("long")})


def plain(rows):
    """Places of every surface; none for files of 2^64 bytes and more."""
    up = lambda a, b: -(-a // b)
    out = {}
    for file_id, _, width, height, depth, mips, size, dim, kind, n, bw, bh, p1, p2, sx, sy in rows:
        at, own = 0, {}
        for e in range(size):
            for m in range(mips):
                w, h, d = max(width >> m, 1), max(height >> m, 1), max((depth or 1) >> m, 1) if dim == 4 else 1
                length = w * h * n if kind == "fixed" else up(w, bw) * up(h, bh) * n if kind == "block" else p1 * w * h + p2 * up(w, sx) * up(h, sy)
                for s in range(d):
                    own[file_id, e, m, s] = (w, h, at, length)
                    at += length
        if at < 1 << 64:
            out |= own
    return out


def test_small_and_huge_layouts(spark):
    rows, given = headers(spark)
    laid = layout.with_layout(given)
    got = {(r.file_id, r.array_index, r.mip_level, r.depth_slice): (r.width, r.height, int(r.offset), int(r.len)) for r in layout.surfaces(laid).collect()}
    expected = plain(rows)
    assert got == expected
    assert any(v[2] + v[3] >= layout._LONGS for v in expected.values())  # the way in decimals is tested too


def test_cursor_places(spark):
    rows, given = headers(spark)
    found = {}
    for r in layout.cursor(layout.with_layout(given.filter("width < 16777217"))).collect():
        found.setdefault(r.file_id, {})[r.ordinal] = ((r.file_id, r.array_index, r.mip_level, r.depth_slice), r.elapsed, r["count"])
    expected = {}
    for key, (_, _, at, _) in plain([r for r in rows if r[2] <= 1 << 24]).items():
        own = expected.setdefault(key[0], {})
        own[len(own)] = (key, at)
    assert {f: {i: v[:2] for i, v in own.items()} for f, own in found.items()} == expected
    assert all(v[2] == len(own) for own in found.values() for v in own.values())


def test_sums_of_a_file_are_made_once(spark):
    """Filters on the layout's error must not make the sum over the levels again, nor anything a surface does."""
    laid = layout.with_layout(headers(spark)[1])
    plan = layout.cursor(laid).select("file_id", "ordinal", "elapsed", "skip_to")._jdf.queryExecution().optimizedPlan().toString()
    makers = [line for line in plan.split("\n") if "aggregate(" in line]
    assert all(re.match(r"[ :+|-]*Generate", x) or "AS _each#" in x for x in makers), makers
    assert sum("AS _each#" in x for x in makers) <= 1 and len(makers) <= 3
