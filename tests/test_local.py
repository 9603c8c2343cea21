"""Small tables of the driver: the same rows as by createDataFrame, and no Python workers for them."""

import datetime

from texloom.functions import formats as dims
from texloom.functions.local import local_table
from texloom.operators import bc6, packed


def test_rows_are_those_of_createdataframe(spark):
    schema = "a long, b int, c string, d boolean, e array<int>, f array<array<int>>, g double, h struct<x:int,y:string>, i date"
    rows = [(1, 2, "é", True, [1, None], [[1], []], 0.5, {"x": 1, "y": None}, datetime.date(2020, 1, 2)), (None,) * 9, (-(2**63), -1, "", False, [], None, float("inf"), {"x": None, "y": "z"}, None)]
    got, want = local_table(spark, rows, schema), spark.createDataFrame(rows, schema)
    assert got.schema == want.schema and got.collect() == want.collect()
    none = local_table(spark, [], schema)
    assert none.schema == want.schema and none.collect() == []


def test_no_python_workers_for_tables_of_formats(spark):
    for table in (dims.formats(spark), dims.dxgi(spark), dims.fourccs(spark), dims.masks(spark), packed.fields_table(spark), bc6.modes_table(spark)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "RDD" not in plan, plan
    assert [tuple(r) for r in dims.formats(spark).collect()] == dims.format_rows()
    assert [tuple(r) for r in dims.masks(spark).collect()] == dims.mask_rows()
