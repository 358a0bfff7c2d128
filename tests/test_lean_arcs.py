"""Arcs as Spark counts them: long objects are cut at days, others not; few shuffles; the plainer SQL says the same."""

import random

import pytest

from ocspark.log import EventLog
from ocspark.operators import arcs
from ocspark.operators.arcs import Arc
from ocspark.plans import cuts

HOUR = 3_600_000_000


class Plain:
    """Asks for the SQL that another engine gets."""

    name = "duck"


def make(spark, seed):
    rng = random.Random(seed)
    events = [(f"e{i:03}", rng.choice("ABC"), rng.randrange(12) * 7 * HOUR) for i in range(60)]
    links = sorted({(e, f"{t}{rng.randrange(4)}", t) for e, _, _ in events for t in "uv" for _ in range(rng.randint(0, 3))})
    return EventLog(
        spark.createDataFrame(events, "eid string, activity string, us long"), spark.createDataFrame(sorted({(o, t) for _, o, t in links}), "oid string, otype string"),
        spark.createDataFrame(links, "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )


@pytest.mark.parametrize("long_", [3, 100_000])
def test_each_labels_of_long_objects(spark, monkeypatch, long_):
    monkeypatch.setattr(cuts, "LONG", long_)
    log = make(spark, long_)
    for arc in ("AS", "EF", "EP"):
        for each in (("u",), ("u", "v")):
            for tgt in "BA":
                a = Arc("A", tgt, arc, each=each)
                one, two = (log.sql(arcs.bindings_sql(a, d)) for d in (arcs.SPARK, Plain))
                assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())), a
    one = log.sql(f"select oid, us, eid, b_ns, b_nt, prev from {arcs._prefixes_lean(*arcs._assigned(('u', 'v')), 'A', 'B')} b")
    two = log.sql(f"select oid, us, eid, b_ns, b_nt, prev from {arcs._prefixes(arcs.assignments(('u', 'v')), 'A', 'B', '')} b")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


@pytest.mark.parametrize("labels", [{"all_": ("u",)}, {"all_": ("u", "v")}, {"all_": ("u",), "any_": ("v",)}, {"any_": ("u",)}, {"any_": ("u", "v")}], ids=str)
def test_loose_labels(spark, labels):
    log = make(spark, 5)
    for arc in ("AS", "EF", "DP"):
        a = Arc("A", "B", arc, **labels)
        one, two = (log.sql(arcs.bindings_sql(a, d)).select("eid", "bid", "n") for d in (arcs.SPARK, Plain))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())), a


@pytest.mark.parametrize("arc", [Arc("A", "B", "AS", all_=("u",), any_=("v",)), Arc("A", "B", "DF", any_=("u",))], ids=str)
def test_few_shuffles(spark, arc):
    log = make(spark, 5)
    log.joined = log.eo.localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = lambda d: log.sql(arcs.bindings_sql(arc, d))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert shuffles(arcs.SPARK) < shuffles(Plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
