"""Random forests on counts against the forest over rows, and on classes that are known."""

import numpy as np
import pytest

from cytomill.operators import forest


def _rows(spark, n, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.random(n)
    y = np.where(a < 4, 0, np.where(b < 5, 1, 2))
    return spark.createDataFrame([(float(p), int(q), float(r), int(k)) for p, q, r, k in zip(a, b, c, y)], "a double, b int, c double, y long")


def _confusion(df):
    return {(int(r["y"]), int(r["prediction"])): r["n"] for r in df.collect()}


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_known_classes_by_both_routes(spark, most):
    df = _rows(spark, 3000)
    want = {(r["y"], r["y"]): r["count"] for r in df.groupBy("y").count().collect()}
    assert _confusion(forest.forest_confusion(df, ["a", "b", "c"], "y", trees=20, depth=6, most=most)) == want


def test_counted_rows_weigh_as_rows(spark):
    """Noisy labels: the majority of each cell decides, however many rows it has; the order of rows changes nothing."""
    few = spark.createDataFrame([(1.0, 0, 3), (1.0, 1, 40), (2.0, 0, 25), (2.0, 1, 2)], "a double, y long, k int")
    df = few.selectExpr("a", "y", "7 as same", "explode(sequence(1, k)) as i")
    got = [_confusion(forest.forest_confusion(d, ["a", "same"], "y", trees=8, depth=2)) for d in (df, df.orderBy("i").repartition(5))]
    assert got[0] == got[1] == {(0, 1): 3, (1, 1): 40, (0, 0): 25, (1, 0): 2}


def test_tasks_grow_from_cells_not_rows(spark):
    df = spark.range(20_000).selectExpr("id % 7 as a", "id % 5 as b", "cast(id % 7 < 3 as int) as y")
    plan = forest.forest_confusion(df, ["a", "b"], "y", trees=8, depth=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # the rows were counted once, into 35 cells


def test_missing_values_fail(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 1)], "a double, y long")
    with pytest.raises(Exception, match="missing values"):
        forest.forest_confusion(df, ["a"], "y").collect()
