"""Documents of a whole log: written in parts and joined, read back equal; the plain forms of JSON."""

import json

import pytest
from pyspark.sql import functions as F

from ocspark.sources import loaders
from ocspark.sources.registered import small_log


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_document_round_trip(spark, tmp_path):
    log = small_log(spark, "; ".join(f"e{i:03},{'AB'[i % 2]},{i},c{i % 7} v{i % 3}" for i in range(200)))
    log.ev = log.ev.withColumn("us", F.col("us") * 60_000_000 + 1)
    log.o2o = spark.createDataFrame([("c1", "v1", "uses"), ("c1", "v2", None)], "src string, dst string, qualifier string")
    log.event_attributes = spark.createDataFrame([("e001", "note", 'a "b"\n, {'), ("e001", "cost", "5")], "eid string, name string, value string")
    log.object_attributes = spark.createDataFrame([("c1", "state", "new", None), ("c1", "state", "old", 7_000_000)], "oid string, name string, value string, us long")
    log.qualifiers = spark.createDataFrame([("e000", "c0", "main")], "eid string, oid string, qualifier string")
    path, joined = str(tmp_path / "parts"), str(tmp_path / "log.json")
    loaders.write_document(log, path, joined)
    whole = json.load(open(joined))
    assert list(whole) == ["version", "ordering", "objectTypes", "eventTypes", "objects", "events"]
    assert [e["id"] for e in whole["events"]] == [f"e{i:03}" for i in range(200)] and [o["id"] for o in whole["objects"]] == sorted(r.oid for r in log.ob.collect())
    assert whole["objectTypes"][0] == {"name": "C", "attributes": [{"name": "state", "type": "string"}]} and whole["objects"][1]["attributes"] == [{"name": "state", "time": "1970-01-01T00:00:00.000001Z", "value": "new"}, {"name": "state", "time": "1970-01-01T00:00:07.000000Z", "value": "old"}]
    for at in (path, joined):
        back = loaders.read_document(spark, at)
        for name in ("ev", "ob", "e2o", "event_attributes"):
            assert rows(getattr(back, name).select(getattr(log, name).columns)) == rows(getattr(log, name)), name
        assert rows(back.object_attributes.select("name", "value")) == [("state", "new"), ("state", "old")] and rows(back.o2o) == [("c1", "v1", "uses"), ("c1", "v2", "")]
        assert ("e000", "c0", "main") in rows(back.qualifiers)
    with pytest.raises(ValueError):
        log.ev = log.ev.withColumn("us", F.lit(None).cast("long"))
        loaders.write_document(log, str(tmp_path / "none"))


def test_empty_document(spark, tmp_path):
    log = small_log(spark, "e1,A,1,c1")
    log.ev, log.ob, log.e2o = log.ev.limit(0), log.ob.limit(0), log.e2o.limit(0)
    loaders.write_document(log, str(tmp_path / "p"), str(tmp_path / "f"))
    assert json.load(open(tmp_path / "f")) == {"version": "2.0", "ordering": "timestamp", "objectTypes": [], "eventTypes": [], "objects": [], "events": []}
    assert loaders.read_document(spark, str(tmp_path / "f")).ev.count() == 0


def test_named_maps_and_traces(spark, tmp_path):
    named = {"events": {"e1": {"activity": "A", "timestamp": "2026-01-01T00:00:00Z", "omap": ["o1"]}}, "objects": {"o1": {"type": "T", "attributes": {}, "relationships": [{"objectId": "o2", "qualifier": "q"}]}}}
    (tmp_path / "named.json").write_text(json.dumps(named, indent=1))
    log = loaders.read_json(spark, str(tmp_path / "named.json"))
    assert rows(log.ev) == [("e1", "A", 1767225600000000)] and rows(log.e2o) == [("e1", "o1", "T")] and rows(log.o2o) == [("o1", "o2", "q")]
    (tmp_path / "traces.json").write_text(json.dumps([["a", "b"], [], ["c"]], indent=1))
    log = loaders.read_json(spark, str(tmp_path / "traces.json"))
    assert [(e, a) for e, a, _ in rows(log.ev)] == [("e_0", "a"), ("e_1", "b"), ("e_2", "c")] and rows(log.e2o.select("eid", "oid"))[2] == ("e_2", "case_2")
    (tmp_path / "other.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        loaders.read_json(spark, str(tmp_path / "other.json"))
