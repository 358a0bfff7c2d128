"""Attributes of objects: guards on them, values changed by events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("==", "!=", ">", "<", ">=", "<=")


def compare(a: Column, op: str, value: object) -> Column:
    """a op value: as numbers if both are numbers, else as texts. A null never passes, nor does anything under an unknown op."""
    if op not in OPS:
        return F.lit(False)
    x, y = a.try_cast("double"), F.lit(None if value is None else str(value)).try_cast("double")
    both = x.isNotNull() & y.isNotNull()
    text = F.lit(str(value))

    def by(p: Column, q: Column) -> Column:
        return {"==": p == q, "!=": p != q, ">": p > q, "<": p < q, ">=": p >= q, "<=": p <= q}[op]

    return a.isNotNull() & F.when(both, by(x, y)).otherwise(by(a.cast("string"), text))


def guarded(objects: DataFrame, attributes: DataFrame, attribute: str, op: str, value: object) -> DataFrame:
    """The rows of objects (oid, ...) whose attribute (oid, name, value; one row each) passes; an object without it doesn't."""
    ok = attributes.where(F.col("name") == attribute).where(compare(F.col("value"), op, value)).select("oid").distinct()
    return objects.join(ok, "oid", "left_semi")


def latest(history: DataFrame) -> DataFrame:
    """oid, name, value: the last of each attribute's values (oid, name, value, us); those without a time come first."""
    return history.groupBy("oid", "name").agg(F.max_by("value", F.struct(F.coalesce("us", F.lit(-(2**62))).alias("us"), "value")).alias("value"))


def changed(changes: DataFrame) -> DataFrame:
    """History of attributes changed by events: oid, name, us, eid, value after the change.

    changes: oid, name, us, eid, op ('set', 'increment', 'decrement'), value (by how much for
    the last two; null: 1). An attribute begins at 0. Changes are summed from the last set on,
    by windows over an object's attribute.
    """
    order = Window.partitionBy("oid", "name").orderBy("us", "eid")
    step = F.when(F.col("op") == "increment", F.coalesce("value", F.lit(1.0))).when(F.col("op") == "decrement", -F.coalesce("value", F.lit(1.0))).otherwise(0.0)
    rows = changes.where(F.col("op").isin("set", "increment", "decrement")).withColumn("__step", step).withColumn("__set", (F.col("op") == "set").cast("int"))
    rows = rows.withColumn("__part", F.sum("__set").over(order))
    since = Window.partitionBy("oid", "name", "__part").orderBy("us", "eid")
    base = F.coalesce(F.first(F.when(F.col("__set") == 1, F.col("value"))).over(since), F.lit(0.0))
    return rows.select("oid", "name", "us", "eid", (base + F.sum("__step").over(since)).alias("value"))
