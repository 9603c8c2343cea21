"""Models that are sent to the tasks: what the driver keeps of them."""

import re

import numpy as np
from pyspark.sql import functions as F

from texloom.llm import common
from texloom.llm.lookup import Entries, Model


def own_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\s+(\d+)", f.read()).group(1)) / 1024


def test_driver_keeps_no_entries(spark):
    """Three models of two million entries each (40 MB as Arrow) leave the driver's Python as small as it was."""
    rows = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(9)).cast("int").alias("kind"), F.xxhash64((F.col("id") / 2).cast("long")).alias("gram"), (F.col("id") % 4).cast("int").alias("col"), F.lit(0.5).cast("float").alias("value"))
    before = own_mb()
    for _ in range(3):
        model = Model(common.written(rows))
        assert own_mb() - before < 30
        model.shared.unpersist()


def test_collected_entries_are_the_table(spark):
    rows = [(1, -5, 0, 0.5), (1, -5, 2, 0.25), (1, 7, 1, 1.0), (3, 7, 0, 2.0)]
    table = spark.createDataFrame(rows, "kind int, gram long, col int, value float")
    for parts in (1, 3):
        got = Entries.collected(table.repartition(parts))
        found, cols, values = got.find(1, np.array([7, 8, -5], np.int64).view(np.uint64))
        assert list(zip(found.tolist(), cols.tolist(), values.tolist(), strict=True)) == [(0, 1, 1.0), (2, 0, 0.5), (2, 2, 0.25)]
        assert [x.tolist() for x in got.find(3, np.array([7], np.uint64))] == [[0], [0], [2.0]]
    assert Entries.collected(table.filter("kind > 9")).of == {}
