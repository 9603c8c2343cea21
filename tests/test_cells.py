"""Work within blocks against plain loops."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from texloom.functions import bc_tables
from texloom.operators import cells
from texloom.plans import cell_queries
from texloom.plans.codec_queries import ORACLES


def plain_codes(cell, palette):
    carried, codes = np.zeros(16), []
    for i in range(16):
        x, y = i % 4, i // 4
        value = cell[i] + carried[i]
        k = int(np.argmin((value - palette) ** 2))
        codes.append(k)
        error = value - palette[k]
        if y == 3:
            shares = {1: 8} if x < 3 else {}
        elif x == 0:
            shares = {1: 7, 4: 6, 5: 2}
        elif x == 3:
            shares = {3: 5, 4: 7}
        else:
            shares = {1: 7, 3: 3, 4: 5, 5: 1}
        for step, share in shares.items():
            carried[i + step] += error * share / 16
    return codes


def test_diffusion_equals_a_loop_and_keeps_the_mean(spark):
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, 256, 16).astype(float).tolist() for _ in range(40)] + [[7.0] * 16, [0.0] * 15 + [255.0]]
    two = [0.0, 255.0]  # a coarse palette, where diffusion matters
    for palette in (None, two):
        frame = spark.createDataFrame(list(enumerate(blocks)), "id long, cell array<double>")
        given = cells.value_palette(F.col("cell")) if palette is None else F.array(*(F.lit(v) for v in palette))
        frame = frame.withColumn("palette", given)
        for r in frame.select("id", "palette", cells.diffused_codes(F.col("cell"), F.col("palette")).alias("codes")).collect():
            assert r.codes == plain_codes(np.array(blocks[r.id]), np.array(r.palette))
            if palette is not None and r.id < 40:
                nearest = abs(np.mean([palette[int(v > 127.5)] for v in blocks[r.id]]) - np.mean(blocks[r.id]))
                assert abs(np.mean([palette[k] for k in r.codes]) - np.mean(blocks[r.id])) <= nearest + 16


def test_null_block_is_null(spark):
    frame = spark.createDataFrame([(1, None)], "id long, cell array<double>")
    assert frame.select(cells.sorted_by_subset(F.col("cell"), F.array(*[F.lit(0)] * 16)).alias("c")).first().c is None


def test_stable_partition_of_all_tables(spark):
    cell = list(range(16))
    frame = spark.createDataFrame([(n, p, cell, [int(c) for c in row]) for n, rows in ((2, bc_tables.TWO), (3, bc_tables.THREE)) for p, row in enumerate(rows)], "n int, p int, cell array<int>, subs array<int>")
    rows = frame.withColumn("out", cells.sorted_by_subset(F.col("cell"), F.col("subs"))).collect()
    assert len(rows) == 128
    for r in rows:
        assert r.out == sorted(cell, key=lambda i: r.subs[i])  # Python's sort is stable


def test_colour_bits_are_distinct(spark):
    kinds = [(c, p) for c in cells.CHANNELS for p in cells.PRECISIONS]
    frame = spark.createDataFrame([(c.upper(), p.upper()) for c, p in kinds], "c string, p string")
    assert sorted(r.b for r in frame.select(cells.colour_bit(F.col("c"), F.col("p")).alias("b")).collect()) == [1 << i for i in range(12)]


def test_diffusion_adds_errors_in_the_order_of_the_sql(spark, tmp_path):
    """Blocks where the sum of the errors first, then of the value, rounds to another code than adding one by one."""
    reds = [
        [151, 114, 129, 125, 139, 128, 143, 138, 121, 147, 138, 139, 123, 142, 124, 151], [122, 140, 125, 90, 105, 133, 134, 127, 113, 127, 137, 123, 154, 142, 102, 143],
        [129, 140, 127, 139, 129, 137, 123, 128, 132, 129, 132, 115, 133, 153, 139, 136],
    ]
    rows = [(i, [x for r in block for x in (r / 255 * 2 - 1, 0.0, 0.0, 0.0)]) for i, block in enumerate(reds)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.codes for r in cell_queries.q_local_diffusion(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == dict(con.execute(ORACLES["q_local_diffusion"]).fetchall())
    assert got[0] == "0,1,5,6,3,6,2,4,7,2,3,3,6,3,6,0"
