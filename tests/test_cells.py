"""The index by cells gives what the full scan gives, from fewer files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from whyframe.operators import leaves
from whyframe.operators.cells import OUTSIDE, Cells, build_cells
from whyframe.operators.retrieval import vector_top_k
from whyframe.sources.tables import RID, register


def check(spark, rows, path, queries, k, cells=12, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    build_cells(df, path, cells)
    index = Cells(spark, path)
    assert index.vectors.count() == len(rows)
    for q in queries:
        want = [tuple(r) for r in vector_top_k(df, F.lit([float(x) for x in q]), k).collect()]
        assert [tuple(r) for r in index.top_k(q, k).collect()] == want
    return index


def test_as_the_full_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 5
    rows = [(i, (centres[i % 12] + rng.normal(size=6)).tolist()) for i in range(1500)]
    index = check(spark, rows, f"file://{tmp_path}/a", [rows[3][1], [0.0] * 6, (centres[1] * 3).tolist()], 7)
    q = np.array(rows[3][1])
    near = index.within(q, index.reach(q, 7))
    assert near.select("cell").distinct().count() < len(index.numbers) / 2 and near.count() < 500
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_ties_at_the_border_and_odd_vectors(spark, tmp_path):
    grid = [(x * 10 + y, [float(x), float(y)]) for x in range(10) for y in range(10)]
    rows = grid + [(500 + i, v) for i, v in grid[:20]]
    check(spark, rows, f"file://{tmp_path}/b", [[4.0, 4.0], [4.5, 4.5], [0.0, 0.0], [100.0, 0.0]], 9)
    odd = [(900, None), (901, []), (902, [1.0]), (903, [float("nan"), 0.0]), (904, [None, 1.0])]
    index = check(spark, rows[:60] + odd, f"file://{tmp_path}/c", [[3.0, 3.0]], 8)
    assert index.vectors.where(F.col("cell") == OUTSIDE).count() == len(odd)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(i, [1.0, 1.0]) for i in range(30)]])
def test_few_and_equal_vectors(spark, tmp_path, rows):
    check(spark, rows, f"file://{tmp_path}/d", [[1.0, 1.0], [5.0, 5.0]], 4)


def test_pages_by_key(spark, tmp_path):
    """All rows once, in the order of the keys as numbers, the bound pushed into the scan."""
    spark.range(120).selectExpr("CAST(119 - id AS long) AS o_orderkey", "id % 7 AS o_custkey").repartition(3).write.parquet(f"{tmp_path}/orders")
    register(spark, {"orders": spark.read.parquet(f"{tmp_path}/orders")})
    seen, last = [], None
    while page := [r[RID] for r in leaves.leaf_page_by_key(spark, "orders", ["o_custkey"], ["o_custkey <> 3"], 25, last).collect()]:
        seen, last = seen + page, page[-1]
    assert seen == [f"orders_{k + 1}" for k in range(120) if (119 - k) % 7 != 3]
    plan = leaves.leaf_page_by_key(spark, "orders", ["o_custkey"], [], 25, "orders_100")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,99)" in plan and "TakeOrderedAndProject" in plan
    register(spark, {"region": spark.createDataFrame([(f"region_{i}", i) for i in range(12)], "region_rownum string, r_regionkey int")})
    assert [r[RID] for r in leaves.leaf_page_by_key(spark, "region", ["r_regionkey"], [], 3, "region_1").collect()] == ["region_10", "region_11", "region_2"]
