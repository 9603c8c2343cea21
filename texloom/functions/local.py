"""Small tables of the driver as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """`spark.createDataFrame(rows, schema)` by way of Arrow: rows given as a list are turned by Python workers of their own on
    the executors (a process for each core and one to start them, which stay), these are part of the plan."""
    kinds = StructType.fromDDL(schema)
    rows = list(rows)
    arrow = to_arrow_schema(kinds)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kinds)
