"""The order log as projections of numbered lines: the relations' SQL over the tables says the same, whatever the tables hold."""

import datetime as dt
import os
import random
from collections import Counter
from urllib.parse import urlparse

import pytest

from ocspark import log
from ocspark.operators import joint, params
from ocspark.plans.dialect import DUCK, SPARK
from ocspark.storage import shared_dir

DATA = "/root/testdata/sf0.01"


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("repeated", [False, True])
def test_relations_of_odd_tables(spark, tmp_path, repeated):
    """Lines that share a number, lines equal in all that a relation shows, orders without lines, missing keys, order keys given twice."""
    rng = random.Random(4)
    day = lambda: dt.datetime(2024, 1, rng.randrange(1, 5))
    orders = [(k, rng.randrange(4), day()) for k in [*range(12), None]] + [(3, 1, day()), (3, 1, day())] * repeated
    lines = [(rng.choice([None, *range(10), 20]), rng.choice([None, 0, 1, 2]), rng.choice([0, 1]), rng.randrange(3), float(rng.randrange(2)), 1.0, 0.0, 0.0, "N", "O", day()) for _ in range(80)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    given, plain = log.project(spark, str(tmp_path), "o"), log._project(spark, str(tmp_path), "o")
    for r in ("ev", "ob", "e2o", "o2o", "eo"):
        one, two = getattr(given, r), getattr(plain, r)
        assert one.columns == two.columns and Counter(one.collect()) == Counter(two.collect()), r


def test_little_is_stored(spark):
    """What the log keeps in the shared folder is less than its tables; it was several times as much."""
    at = urlparse(shared_dir(spark)).path
    log._stored.clear()
    before = size(at)
    made = log.project(spark, DATA, "o")
    assert 0 < size(at) - before < os.path.getsize(f"{DATA}/lineitem.parquet")
    assert "Exchange" not in made.eo._jdf.queryExecution().executedPlan().toString()


def test_objects_of_events_meet_in_one_shuffle(spark):
    """Events of joint labels are gathered with the objects of all types at once; it took a shuffle for each type's, and one for all."""
    made = log.project(spark, DATA, "o")
    plan = joint.with_objects(made, ("order", "part"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    row = plan.where("eid = 'po_5'").first()
    assert row.xs == {"order": ["order_5"]}


def test_diagnostics_of_odd_logs(spark):
    """Repeated links, events and objects alone, links of no event, missing times; events' names are shuffled once."""
    made = log.EventLog(
        spark.createDataFrame([("a", "A", 1), ("b", "A", 1), ("c", "B", None), ("d", "B", 2), (None, "B", 3)], "eid string, activity string, us long"), spark.createDataFrame([("x", "t"), ("y", "t"), ("z", "t")], "oid string, otype string"),
        spark.createDataFrame([("a", "x", "t"), ("a", "x", "t"), ("b", "x", "t"), ("c", "y", "t"), ("q", "y", "t"), (None, "y", "t")], "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )
    texts = [params.log_diagnostics.write(d) for d in (SPARK, DUCK)]
    one, two = (made.sql(text) for text in texts)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(eid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = (made.sql(text) for text in texts)
        assert shuffles(one) < shuffles(two)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
