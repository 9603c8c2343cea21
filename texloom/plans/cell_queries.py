"""Registered queries of work within blocks and of sets of colours, with independent DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from texloom.functions import bc_tables
from texloom.functions import formats as dims
from texloom.functions.local import local_table
from texloom.operators import cells
from texloom.plans import fixtures as X
from texloom.plans.texture_queries import query

# Sixteenths of the error for the pixel to the right, below left, below and below right, by the pixel's column; the last row
# only gives to the right (8).
_SHARES = "sh AS (SELECT * FROM (VALUES (0, 7, 0, 6, 2), (1, 7, 3, 5, 1), (2, 7, 3, 5, 1), (3, 0, 5, 7, 0)) t(x, r, bl, b, br))"
_WEIGHTS = """wt AS (SELECT p // 1 AS p, list(CASE WHEN p // 4 = 3 THEN CASE WHEN q = p + 1 AND x < 3 THEN 0.5 ELSE 0 END WHEN q = p + 1 AND x < 3 THEN r / 16 WHEN q // 4 <> p // 4 + 1 THEN 0
  WHEN q % 4 = x - 1 THEN bl / 16 WHEN q % 4 = x THEN b / 16 WHEN q % 4 = x + 1 THEN br / 16 ELSE 0 END::DOUBLE ORDER BY q) AS w FROM (SELECT unnest(range(16)) AS p), (SELECT unnest(range(16)) AS q), sh WHERE sh.x = p % 4 GROUP BY p)"""


@query(
    f""", {_SHARES}, {_WEIGHTS}, ce AS (SELECT vec_id, list(CAST(r AS DOUBLE) ORDER BY i) AS cell, max(r)::DOUBLE AS hi, min(r)::DOUBLE AS lo FROM vp GROUP BY vec_id),
pa AS (SELECT vec_id, cell, [hi, lo, (hi * 6 + lo * 1) / 7, (hi * 5 + lo * 2) / 7, (hi * 4 + lo * 3) / 7, (hi * 3 + lo * 4) / 7, (hi * 2 + lo * 5) / 7, (hi * 1 + lo * 6) / 7] AS pal FROM ce),
st AS (SELECT vec_id, 0 AS p, cell, pal, '' AS codes FROM pa
UNION ALL SELECT vec_id, p + 1, list_transform(list_zip(cell, w), lambda z: z[1] + (cell[p + 1] - pal[k]) * z[2]), pal, concat(codes, CASE WHEN p = 0 THEN '' ELSE ',' END, k - 1)
  FROM (SELECT st.*, w, list_position(list_transform(pal, lambda e: (cell[p + 1] - e) * (cell[p + 1] - e)), list_min(list_transform(pal, lambda e: (cell[p + 1] - e) * (cell[p + 1] - e)))) AS k FROM st JOIN wt USING (p) WHERE p < 16))
SELECT vec_id, codes FROM st WHERE p = 16""",
    X.VECTORS_SQL.replace("vx AS", "RECURSIVE vx AS", 1),
)
def q_local_diffusion(spark, sf_dir):
    """The codes of each block's reds in its BC4 palette, errors carried on within the block."""
    blocks = cells.block_arrays(X.vectors(spark, sf_dir), ["vec_id"], "r").withColumn("palette", cells.value_palette(F.col("cell")))
    return blocks.select("vec_id", F.concat_ws(",", cells.diffused_codes(F.col("cell"), F.col("palette")).cast("array<string>")).alias("codes"))


_ROWS = [(n, part, row) for n, rows in ((2, bc_tables.TWO), (3, bc_tables.THREE)) for part, row in enumerate(rows)]


@query(
    """, sb AS (SELECT vec_id, n, part, i, r, CAST(substr(subs, CAST(i + 1 AS INTEGER), 1) AS INTEGER) AS sub FROM vp, pt)
SELECT vec_id, n AS subsets, CAST(part AS BIGINT) AS part, string_agg(r, ',' ORDER BY sub, i) AS cell, count(*) FILTER (sub = 0) AS n0 FROM sb GROUP BY ALL""",
    X.VECTORS_SQL, "pt AS (SELECT * FROM (VALUES " + ", ".join(f"({n}::BIGINT, {part}, '{row}')" for n, part, row in _ROWS) + ") t(n, part, subs))",
)
def q_stable_partition(spark, sf_dir):
    """Each block's reds sorted by subset, for all partitions into two and three."""
    table = F.array(*(F.struct(F.lit(n).cast("long").alias("subsets"), F.lit(part).cast("long").alias("part"), F.lit(row).alias("row")) for n, part, row in _ROWS))
    blocks = cells.block_arrays(X.vectors(spark, sf_dir), ["vec_id"], "r").select("vec_id", "cell", F.inline(table))
    subs = F.transform(F.split("row", ""), lambda c: c.cast("int"))
    each = blocks.withColumn("subs", subs)
    values = cells.sorted_by_subset(F.col("cell"), F.col("subs"))
    return each.select("vec_id", "subsets", "part", F.concat_ws(",", F.transform(values, lambda v: v.cast("long").cast("string"))).alias("cell"), F.size(F.filter("subs", lambda s: s == 0)).cast("long").alias("n0"))


_KINDS = ["grayscale", "alpha", "rgb", "rgba"]
_SETS_SQL = "fc AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {3 * _KINDS.index(r[1].lower()) + ['u8', 'u16', 'f32'].index(r[2].lower())})" for i, r in enumerate(dims.format_rows())) + ") t(format_no, key))"


@query(
    """SELECT shape, depth, CAST(sum(DISTINCT 1::BIGINT << key) AS BIGINT) AS seen, count(DISTINCT key) AS n_seen, CAST(CASE WHEN count(DISTINCT key) = 1 THEN max(1::BIGINT << key) ELSE 0 END AS BIGINT) AS common, bool_or(key % 3 = 2) AS any_float,
count(DISTINCT key) = 12 AS is_all FROM od JOIN fc USING (format_no) GROUP BY shape, depth""",
    X.ORDERS_SQL, _SETS_SQL,
)
def q_colour_sets(spark, sf_dir):
    """Union, intersection, size and membership of the native colour kinds of the files of each shape and depth."""
    table = local_table(spark, [(i, r[1], r[2]) for i, r in enumerate(dims.format_rows())], "format_no long, channels string, precision string")
    found = X.orders(spark, sf_dir).join(F.broadcast(table), "format_no").withColumn("kind", cells.colour_bit(F.col("channels"), F.col("precision")))
    sets = found.groupBy("shape", "depth").agg(F.bit_or("kind").alias("seen"), F.bit_and("kind").alias("common"))
    floats = sum(1 << (3 * c + 2) for c in range(4))
    return sets.select("shape", "depth", "seen", F.bit_count("seen").cast("long").alias("n_seen"), "common", (F.col("seen").bitwiseAND(floats) != 0).alias("any_float"), (F.col("seen") == (1 << 12) - 1).alias("is_all"))
