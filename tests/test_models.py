"""Model files, attributes, graphs and audits on small inputs whose results are known."""

import json
import random

import pytest

from ocspark.operators import attributes, audits, evaluate, graph
from ocspark.operators.arcs import Arc
from ocspark.sources import exploder, models
from ocspark.sources.registered import small_log


def test_model_round_trip(spark, tmp_path):
    arcs = [(Arc("A", "B", "EF", each=("order",), any_=("part",), nmin=1, nmax=3), 0.9), (Arc("B", "A", "EP", all_=("order",)), None), (Arc("A", "B", "DP", each=("order",), nmin=0, nmax=0), 0.5)]
    text = models.model_json(arcs)
    models.write_text(spark, text, f"{tmp_path}/m")
    assert models.read_arcs(spark, f"{tmp_path}/m") == [a for a, _ in arcs]
    assert json.loads(text)["stats"] == {"n_constraints": 3, "per_arc_type": {"EF": 1, "EP": 1, "AS": 0, "DF": 0, "DP": 1}, "avg_support": 0.7}


@pytest.mark.parametrize("entry", [{"type": "response", "guard": {"attribute": "x", "op": "==", "value": 1}}, {"type": "alternate_response"}])
def test_not_an_arc(spark, tmp_path, entry):
    models.write_text(spark, json.dumps({"constraints": [{**entry, "source": "A", "target": "B", "scope": {"object_type": "order"}}]}), f"{tmp_path}/m")
    with pytest.raises(NotImplementedError):
        models.read_arcs(spark, f"{tmp_path}/m")


@pytest.mark.parametrize("value", [True, 0, 1.01, float("nan"), "0.5", None])
def test_fraction(value):
    with pytest.raises(ValueError):
        models.fraction(value, "noise")


def test_compare(spark):
    rows = spark.createDataFrame([("5",), ("50",), ("abc",), (None,), ("5.0",)], "v string")
    found = lambda op, value: sorted(r.v for r in rows.where(attributes.compare(rows.v, op, value)).collect())
    assert found("==", 5) == ["5", "5.0"] and found(">", 9) == ["50", "abc"] and found("<", "abd") == ["5", "5.0", "50", "abc"] and found("~", 5) == []


def test_changes(spark):
    rows = [("a", "x", 1, "e1", "increment", None), ("a", "x", 2, "e2", "set", 10.0), ("a", "x", 2, "e3", "decrement", 4.0), ("a", "y", 9, "e4", "decrement", 1.0), ("a", "y", 9, "e5", "erase", 1.0)]
    out = attributes.changed(spark.createDataFrame(rows, "oid string, name string, us long, eid string, op string, value double"))
    assert sorted((r.eid, r.value) for r in out.collect()) == [("e1", 1.0), ("e2", 10.0), ("e3", 6.0), ("e4", -1.0)]


def test_components(spark):
    """A long path, a star, a ring and a loop, with shuffled names, against a union-find by hand."""
    names = [f"n{i:03}" for i in random.Random(7).sample(range(1000), 120)]
    links = [(names[i], names[i + 1]) for i in range(60)] + [(names[70], names[i]) for i in range(71, 90)] + [(names[i], names[90 + (i - 89) % 10]) for i in range(90, 100)] + [(names[110], names[110])]
    root = {n: n for n in names}
    for _ in names:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: root[n] for n in {x for a, b in links if a != b for x in (a, b)}}
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_medians(spark):
    rnd = random.Random(3)
    rows = [(k, round(rnd.lognormvariate(0, 3) * rnd.choice([1, 1, -1]), 3)) for k, n in (("a", 1), ("b", 2), ("c", 101), ("d", 1000)) for _ in range(n)] + [("c", None), ("d", 0.0), ("e", 5.0), ("e", 5.0)]
    got = {r.k: r["median"] for r in audits.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    import statistics

    assert got == pytest.approx({k: statistics.median(v for x, v in rows if x == k and v is not None) for k in "abcde"})


def test_evaluate_sections(spark):
    log = small_log(spark, "a,A,1,c1 v1; b,B,2,c1")
    frame, status = evaluate.evaluate_logs(log, None)
    assert status["logs.input"] == "ok" and status["conformance.input"] == "no model" and status["kl.activities"] == "no log to compare with"
    assert {(r.measure, r.value) for r in frame.collect()} == {("events", 2.0), ("objects", 2.0)}
    frame, status = evaluate.evaluate_logs(log, log, [Arc("A", "B", "EF", each=("C",))])
    assert set(status.values()) == {"ok"}
    found = {(r.section, r.item, r.measure): r.value for r in frame.collect()}
    assert found["kl.activities", "", "kl_forward"] == 0 and found["ngd.2", "all", "ngd"] == 0 and found["conformance.simulated", "", "global_confidence"] == 1


def test_exploder(spark):
    texts = spark.createDataFrame([('{"objects": [{"id": "o", "type": "T"}], "events": [{"id": "e", "type": "A", "time": "1", "relationships": [{"objectId": "o"}, {"objectId": "o"}]}, {"id": "f", "type": "B"}]}',), ("[1]",), ("{",), (None,)], "x string")
    assert sorted(tuple(r) for r in exploder.exploded(texts, "x").collect()) == [("e", "A", "1", "o", "T"), ("f", "B", None, None, None)]


def test_transitive(spark):
    log = small_log(spark, "a,A,1,c1; b,B,2,c2 v2")
    log.ob = log.ob.union(spark.createDataFrame([("v1", "V")], "oid string, otype string"))
    log.o2o = spark.createDataFrame([("v1", "c1", "q"), ("c1", "c2", "q")], "src string, dst string, qualifier string")
    assert [tuple(r) for r in graph.transitive_objects(log, ("C", "V")).collect()] == [("a", "v1")]
    assert sorted((r.oid, r.otype, r.n) for r in graph.neighbors_by_type(log).collect()) == [("c1", "C", 2), ("c1", "V", 1), ("c2", "C", 2), ("v1", "C", 1), ("v1", "V", 1), ("v2", "V", 1)]
