"""Loaders, writers, discovery and stream monitors on small logs."""

import json

import pytest

from ocspark.log import EventLog
from ocspark.operators import mining
from ocspark.sources import loaders
from ocspark.streaming import monitors

EVENTS = [("e1", "A", "2026-01-01T09:00:00Z", ["c1", "v1"]), ("e2", "B", "2026-01-01T10:00:00Z", ["c1"])]


def facts(log):
    return (
        sorted((r.eid, r.activity, r.us) for r in log.ev.collect()),
        sorted((r.eid, r.oid, r.otype) for r in log.e2o.collect()),
        sorted((r.src, r.dst, r.qualifier) for r in log.o2o.collect()),
    )


def test_both_json_versions_and_xml_agree(spark, tmp_path):
    two = {
        "objects": [{"id": "c1", "type": "C", "relationships": [{"objectId": "v1", "qualifier": "has"}]}, {"id": "v1", "type": "V"}],
        "events": [{"id": e, "type": a, "time": t, "relationships": [{"objectId": o, "qualifier": "q"} for o in os]} for e, a, t, os in EVENTS],
    }
    one = {
        "ocel:events": {e: {"ocel:activity": a, "ocel:timestamp": t, "ocel:omap": os} for e, a, t, os in EVENTS},
        "ocel:objects": {"c1": {"ocel:type": "C", "ocel:o2o": [{"objectId": "v1", "qualifier": "has"}]}, "v1": {"ocel:type": "V"}},
    }
    xml = """<log><objects><object id="c1" type="C"><objects><relationship object-id="v1" qualifier="has"/></objects></object><object id="v1" type="V"></object></objects><events>"""
    xml += "".join(f'<event id="{e}" type="{a}" time="{t}"><objects>{"".join(f"""<relationship object-id="{o}" qualifier="q"/>""" for o in os)}</objects></event>' for e, a, t, os in EVENTS) + "</events></log>"
    (tmp_path / "two.json").write_text(json.dumps(two))
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "log.xml").write_text(xml)
    want = facts(loaders.read_json(spark, str(tmp_path / "two.json")))
    assert want[0][0] == ("e1", "A", 1767258000000000) and len(want[1]) == 3 and want[2] == [("c1", "v1", "has")]
    assert facts(loaders.read_json(spark, str(tmp_path / "one.json"))) == want
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        loaders.read_json(spark, str(tmp_path / "bad.json"))
    log = loaders.read_json(spark, str(tmp_path / "two.json"))
    loaders.write_tables(log, str(tmp_path / "t"))
    assert facts(loaders.read_tables(spark, str(tmp_path / "t"))) == want
    loaders.write_json(log, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j/events")).count() == 2


def test_xml(spark, tmp_path):
    (tmp_path / "log.xml").write_text('<log><event id="e1" type="A" time="2026-01-01T09:00:00Z"><relationship object-id="c1" qualifier="q"/></event><object id="c1" type="C"><relationship object-id="c2" qualifier="x"/></object></log>')
    log = loaders.read_xml(spark, str(tmp_path / "log.xml"))
    assert facts(log) == ([("e1", "A", 1767258000000000)], [("e1", "c1", "C")], [("c1", "c2", "x")])


def test_attributes_and_qualifiers(spark, tmp_path):
    attrs = [{"name": "price", "value": 5, "time": "2026-01-01T00:00:00Z"}, {"name": "price", "value": "6", "time": "2026-01-02T00:00:00Z"}]
    doc = {"objects": [{"id": "c1", "type": "C", "attributes": attrs}], "events": [{"id": "e1", "type": "A", "time": "2026-01-01T09:00:00Z", "attributes": [{"name": "who", "value": "x"}], "relationships": [{"objectId": "c1", "qualifier": "by"}, {"objectId": "c1"}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    xml = '<log><object id="c1" type="C"><attributes><attribute name="price" time="2026-01-01T00:00:00Z">5</attribute><attribute name="price" time="2026-01-02T00:00:00Z">6</attribute></attributes></object>'
    xml += '<event id="e1" type="A" time="2026-01-01T09:00:00Z"><attributes><attribute name="who">x</attribute></attributes><relationship object-id="c1" qualifier="by"/></event></log>'
    (tmp_path / "a.xml").write_text(xml)
    for log in (loaders.read_json(spark, str(tmp_path / "a.json")), loaders.read_xml(spark, str(tmp_path / "a.xml"))):
        assert [tuple(r) for r in log.event_attributes.collect()] == [("e1", "who", "x")]
        assert [(r.oid, r.name, r.value, r.us) for r in log.object_attributes.orderBy("us").collect()] == [("c1", "price", "5", 1767225600000000), ("c1", "price", "6", 1767312000000000)]
        assert [tuple(r) for r in log.qualifiers.collect()] == [("e1", "c1", "by")] and log.e2o.count() == 1
    one = {"ocel:events": {"e1": {"ocel:activity": "A", "ocel:timestamp": "2026-01-01T09:00:00Z", "ocel:omap": ["c1"], "ocel:vmap": {"who": "x"}}}, "ocel:objects": {"c1": {"ocel:type": "C", "ocel:ovmap": {"price": 5}}}}
    (tmp_path / "b.json").write_text(json.dumps(one))
    log = loaders.read_json(spark, str(tmp_path / "b.json"))
    assert [tuple(r) for r in log.object_attributes.collect()] == [("c1", "price", "5", None)] and log.event_attributes.first().value == "x"


def test_csv_and_traces(spark, tmp_path):
    (tmp_path / "l.csv").write_text("concept:name,time:timestamp,case:concept:name,EventOrigin,EventID,OfferID\nA,2026-01-01 09:00:00,App1,Application,x,\nO,2026-01-01 10:00:00,App1,Offer,Offer_7,\nW, 2026-01-01 11:00:00,App1,Workflow,w,\n,2026-01-01 12:00:00,App1,Workflow,w,\n")
    log = loaders.read_csv(spark, str(tmp_path / "l.csv"))
    assert log.ev.count() == 3 and {r.otype for r in log.e2o.collect()} == {"Application", "Workflow", "Offer"}
    assert {r.eid for r in log.ev.collect()} == {"evt_0", "evt_1", "evt_2"} and {(r.oid, r.otype) for r in log.ob.collect()} == {("App1", "Application"), ("Offer_7", "Offer"), ("w", "Workflow")}
    head = "concept:name,time:timestamp,case:concept:name,EventOrigin,EventID,OfferID,case:LoanGoal,CreditScore,Accepted\n"
    (tmp_path / "m.csv").write_text(head + "A,,App1,Application,x,,g0,,\nA,2026-01-01 09:00:00,App1,Application,x,,g1,,\nO,2026-01-01 10:00:00,App1,Offer,y,Offer_7,g2, ,\nO,2026-01-01 11:00:00,App1,Offer,y,Offer_7,g3, 9 ,True\nO,2026-01-01 11:00:00,App1,Offer,y,Offer_7,g3,8,False\n")
    log = loaders.read_csv(spark, str(tmp_path / "m.csv"))
    assert {tuple(r)[:3] for r in log.object_attributes.collect()} == {("App1", "case:LoanGoal", "g1"), ("Offer_7", "CreditScore", "9"), ("Offer_7", "Accepted", "True")}
    assert {r.eid for r in log.ev.collect()} == {"evt_1", "evt_2", "evt_3", "evt_4"}
    rows = loaders.numbered(spark.range(1000, numPartitions=7), "n").collect()
    assert all(r.n == r.id for r in rows)
    many = spark.createDataFrame([(i, ["a"] * (i % 3)) for i in range(9000)], "case_no int, trace array<string>").repartition(4)
    got, k = {(r.eid, r.us) for r in loaders.from_traces(many).ev.collect()}, 0
    for i in range(9000):
        for _ in range(i % 3):
            assert (f"e_{k}", 1_704_067_200_000_000 + i * 60_000_000 + k * 1_000_000) in got
            k += 1
    assert len(got) == k
    log = loaders.from_traces(spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "case_no int, trace array<string>"))
    assert log.ev.count() == 3 and log.ob.count() == 2


def test_discovery_of_the_manuscript_log(spark):
    order = "S1 S1 R1 S2 R2 R2 S3 R4 S5 R5 S6 R6 S7 R7 S8 R8 S9 R9 S10 R10".split()
    ev = spark.createDataFrame([(f"e{i:02}", x[0], i) for i, x in enumerate(order)], "eid string, activity string, us long")
    e2o = spark.createDataFrame([(f"e{i:02}", "m" + x[1:], "m") for i, x in enumerate(order)], "eid string, oid string, otype string")
    log = EventLog(ev, e2o.select("oid", "otype").distinct(), e2o, spark.createDataFrame([], "src string, dst string, qualifier string"))
    got = {(a.arc, a.src, a.tgt): s for a, s in mining.discover(log, 0.2)}
    assert got == {("EF", "S", "R"): 0.9, ("EP", "R", "S"): 0.9}
    got = {(a.arc, a.src, a.tgt): s for a, s in mining.discover(log, 0.2, ("EF", "EP", "DF", "DP"))}
    assert got == {("DF", "S", "R"): 0.8, ("DP", "R", "S"): 0.8}


def test_streams(spark, tmp_path):
    rows = [("o1", "A", "2026-01-01 00:00:00"), ("o1", "B", "2026-01-01 01:00:00"), ("o2", "A", "2026-01-01 02:00:00"), ("o3", "A", "2026-01-09 00:00:00"), ("o3", "B", "2026-01-09 00:00:00")]
    df = spark.createDataFrame(rows, "oid string, activity string, t string").selectExpr("oid", "activity", "cast(t as timestamp) ts")
    for k, part in enumerate((df.where("ts < '2026-01-02'"), df.where("ts >= '2026-01-02'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for make, name in ((lambda s: monitors.response_monitor(s, "A", "B"), "resp"), (lambda s: monitors.windowed_counts(s), "win")):
            stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
            q = make(stream).writeStream.option("checkpointLocation", str(tmp_path / name)).format("parquet").option("path", str(tmp_path / f"out-{name}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            q.stop()
    got = {(r.oid, r.verdict) for r in spark.read.parquet(str(tmp_path / "out-resp")).collect()}
    assert ("o1", "fulfilled") in got and ("o2", "violated") in got and ("o3", "fulfilled") not in got
    assert spark.read.parquet(str(tmp_path / "out-win")).where("activity = 'A'").count() >= 2
