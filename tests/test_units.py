"""Bytes to numbers and back, for rows of mixed sizes: grouped reading must give what each value gives by itself."""

from pyspark.sql import functions as F

from texloom.functions.units import numbers_of, with_bytes

CASES = [(b"", 1), (None, 2), (bytes(range(12)), 1), (bytes(range(200, 212)), 3), (b"\x00\x01\xff\x80", 2), (b"\xff" * 8, 4), (b"\x01\x02\x03", 2), (b"\xff" * 16, 8), (b"\x07" * 12, 3), (b"abcd", None), (b"abcd", 0), (bytes(range(100, 112)), 1)] * 5


def test_numbers_and_bytes(spark):
    rows = [(i, data, size) for i, (data, size) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "i int, data binary, size int").coalesce(2)
    read = frame.withColumn("numbers", numbers_of(F.col("data"), F.col("size"))).cache()
    expected = {}
    for i, data, size in rows:
        whole = data is not None and size and len(data) % size == 0
        expected[i] = [int.from_bytes(data[j : j + size], "little", signed=size == 8) for j in range(0, len(data), size)] if whole else None
    assert {r.i: r.numbers for r in read.collect()} == expected
    back = with_bytes(read.select("i", "numbers", "size"), "numbers", "size", "data")
    assert {r.i: None if r.data is None else bytes(r.data) for r in back.collect()} == {i: data if expected[i] is not None else None for i, data, _ in rows}
    read.unpersist()
