"""Parameters, histories and pages."""

import math

import pytest
from pyspark.sql import functions as F

from ocspark.sources import runs


def test_parameters_come_back(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.5, None), ("y", math.nan, [1, 2])], "k string, v double, l array<long>")
    b = spark.createDataFrame([(1,)], "n long")
    runs.write_parameters({"a": a, "b": b, "none": b.limit(0)}, str(tmp_path / "p"))
    back = runs.read_parameters(spark, str(tmp_path / "p"))
    assert set(back) == {"a", "b"} and back["a"].dtypes == a.dtypes
    assert sorted(map(tuple, back["a"].collect())) == [("x", 1.5, None), ("y", None, [1, 2])] and back["b"].first().n == 1
    with pytest.raises(ValueError):
        runs.write_parameters({}, str(tmp_path / "q"))


def test_history_keeps_the_latest(spark, tmp_path):
    for k in (3, 1, 2, 3):
        runs.record(spark, str(tmp_path / "h"), f"r{k}", k, {"k": k})
    assert [(r.run, r.entry) for r in runs.history(spark, str(tmp_path / "h"), 2).collect()] == [("r3", '{"k": 3}'), ("r2", '{"k": 2}')]


def test_pages_in_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "9", "b", "A", None, "a", "1e3")], "x string")
    order = runs.natural("x")
    assert [r.x for r in runs.page(df, order, 1, 4).collect()] == ["9", "10", "1e3", "A"]
    assert [r.x for r in runs.page(df, order, 2, 4).collect()] == ["a", "b", None] and runs.page(df, order, 3, 4).count() == 0
    with pytest.raises(ValueError):
        runs.page(df.withColumn("y", F.lit(1)), order, 0)
