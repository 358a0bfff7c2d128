"""Readers and writers of event logs: JSON of both versions, XML, flat CSV, lists of traces.

Everything is read by Spark's own readers with schemas given, so paths may be in any store
Spark reads. Relations come out as those of EventLog.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..log import EventLog

_REL = "array<struct<objectId:string,qualifier:string>>"
_ATTR = "array<struct<name:string,value:string,time:string>>"
JSON_2 = (
    f"objects array<struct<id:string,type:string,attributes:{_ATTR},relationships:{_REL}>>, "
    f"events array<struct<id:string,type:string,time:string,attributes:{_ATTR},relationships:{_REL}>>"
)
JSON_1 = (
    "`ocel:events` map<string,struct<`ocel:activity`:string,`ocel:timestamp`:string,`ocel:omap`:array<string>,`ocel:vmap`:map<string,string>>>, "
    "`ocel:objects` map<string,struct<`ocel:type`:string,`ocel:ovmap`:map<string,string>,`ocel:o2o`:array<struct<objectId:string,qualifier:string>>>>"
)


def _us(column) -> F.Column:
    return F.unix_micros(F.to_timestamp(column))


def _log(events: DataFrame, objects: DataFrame, links: DataFrame, **more: DataFrame) -> EventLog:
    """events (eid, activity, us, oids), objects (oid, otype), links (src, dst, qualifier)."""
    ob = objects.select("oid", "otype").distinct()
    pairs = events.select("eid", F.explode("oids").alias("oid")).distinct()
    return EventLog(events.select("eid", "activity", "us"), ob, pairs.join(ob, "oid").select("eid", "oid", "otype"), links.distinct(), **more)


def _details(e: DataFrame, o: DataFrame, eid: str, oid: str, event_links, event_attributes, object_attributes, name: str, value: str, time: str, link: str, qualifier: str) -> dict[str, DataFrame]:
    """Attributes and qualifiers out of arrays of structs."""
    ea = e.select(F.col(eid).alias("eid"), F.explode(event_attributes).alias("a")).select("eid", F.col("a").getField(name).alias("name"), F.col("a").getField(value).alias("value"))
    oa = o.select(F.col(oid).alias("oid"), F.explode(object_attributes).alias("a")).select("oid", F.col("a").getField(name).alias("name"), F.col("a").getField(value).alias("value"), _us(F.col("a").getField(time)).alias("us"))
    q = e.select(F.col(eid).alias("eid"), F.explode(event_links).alias("r")).select("eid", F.col("r").getField(link).alias("oid"), F.col("r").getField(qualifier).alias("qualifier"))
    return {"event_attributes": ea, "object_attributes": oa, "qualifiers": q.where("qualifier is not null").distinct()}


#: Events and objects by name, in the plain keys that a loaded log is handed on with.
JSON_NAMED = (
    "events map<string,struct<activity:string,timestamp:string,omap:array<string>>>, "
    "objects map<string,struct<type:string,relationships:array<struct<objectId:string,qualifier:string>>>>"
)


def _read_named(spark: SparkSession, path: str) -> EventLog | None:
    """A log whose events and objects are maps; None if the file has none."""
    raw = spark.read.schema(JSON_NAMED).json(path, multiLine=True)
    if not raw.where("events is not null").limit(1).count():
        return None
    e = raw.select(F.explode("events").alias("eid", "e")).select("eid", F.col("e.activity").alias("activity"), _us("e.timestamp").alias("us"), F.col("e.omap").alias("oids"))
    o = raw.select(F.explode("objects").alias("oid", "o"))
    links = o.select(F.col("oid").alias("src"), F.explode("o.relationships").alias("r")).select("src", F.col("r.objectId").alias("dst"), "r.qualifier")
    return _log(e, o.select("oid", F.col("o.type").alias("otype")), links)


def _read_traces(spark: SparkSession, path: str) -> EventLog | None:
    """A file that is a list of traces, each a list of activities; None if it isn't one."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("x")).where("x is not null and size(x) > 0 and exists(x, t -> t is not null)")
    if not text.limit(1).count():
        return None
    return from_traces(text.select(F.posexplode("x").alias("case_no", "trace")))


def read_json(spark: SparkSession, path: str) -> EventLog:
    """A log in version 2 (lists), version 1 (maps), with attributes and qualifiers; as maps of plain keys; or as a list of traces.

    These forms are one document, so one task reads it; read_document shares a document of one entity a line.
    """
    two = spark.read.schema(JSON_2).json(path, multiLine=True)
    if two.where("events is not null").limit(1).count():
        e = two.select(F.explode("events").alias("e")).select("e.*")
        o = two.select(F.explode("objects").alias("o")).select("o.*")
        events = e.select(F.col("id").alias("eid"), F.col("type").alias("activity"), _us("time").alias("us"), F.col("relationships.objectId").alias("oids"))
        objects = o.select(F.col("id").alias("oid"), F.col("type").alias("otype"))
        links = o.select(F.col("id").alias("src"), F.explode("relationships").alias("r")).select("src", F.col("r.objectId").alias("dst"), "r.qualifier")
        more = _details(e, o, "id", "id", F.col("relationships"), F.col("attributes"), F.col("attributes"), "name", "value", "time", "objectId", "qualifier")
        return _log(events, objects, links, **more)
    one = spark.read.schema(JSON_1).json(path, multiLine=True)
    if not one.where("`ocel:events` is not null").limit(1).count():
        found = _read_named(spark, path) or _read_traces(spark, path)
        if found is None:
            raise ValueError(f"{path} holds no event log")
        return found
    e = one.select(F.explode("ocel:events").alias("eid", "e"))
    o = one.select(F.explode("ocel:objects").alias("oid", "o"))
    events = e.select("eid", F.col("e.ocel:activity").alias("activity"), _us("e.ocel:timestamp").alias("us"), F.col("e.ocel:omap").alias("oids"))
    links = o.select(F.col("oid").alias("src"), F.explode("o.ocel:o2o").alias("r")).select("src", F.col("r.objectId").alias("dst"), "r.qualifier")
    ea = e.select("eid", F.explode("e.ocel:vmap").alias("name", "value"))
    oa = o.select("oid", F.explode("o.ocel:ovmap").alias("name", "value")).withColumn("us", F.lit(None).cast("long"))
    return _log(events, o.select("oid", F.col("o.ocel:type").alias("otype")), links, event_attributes=ea, object_attributes=oa)


def read_xml(spark: SparkSession, path: str) -> EventLog:
    """A log in XML, with attributes and qualifiers: one read for objects and one for events."""
    rel = "array<struct<`_object-id`:string,_qualifier:string>>"
    attr = "attributes struct<attribute:array<struct<_name:string,_time:string,_VALUE:string>>>"
    o = spark.read.format("xml").option("rowTag", "object").schema(f"_id string, _type string, objects struct<relationship:{rel}>, relationship {rel}, {attr}").load(path)
    e = spark.read.format("xml").option("rowTag", "event").schema(f"_id string, _type string, _time string, objects struct<relationship:{rel}>, relationship {rel}, {attr}").load(path)
    both = F.coalesce("relationship", "objects.relationship")
    e, o = e.where("_id is not null"), o.where("_id is not null")
    events = e.select(F.col("_id").alias("eid"), F.col("_type").alias("activity"), _us("_time").alias("us"), both.getField("_object-id").alias("oids"))
    links = o.select(F.col("_id").alias("src"), F.explode(both).alias("r")).select("src", F.col("r._object-id").alias("dst"), F.col("r._qualifier").alias("qualifier"))
    inner = F.col("attributes.attribute")
    more = _details(e, o, "_id", "_id", both, inner, inner, "_name", "_VALUE", "_time", "_object-id", "_qualifier")
    return _log(events, o.select(F.col("_id").alias("oid"), F.col("_type").alias("otype")), links, **more)


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """rows with `out`: their number from 0 in the order that Spark reads them; one count a partition is joined, no row moves."""
    placed = rows.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftrightunsigned("__m", 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).select("__p", "__b")  # a row a partition
    return placed.join(F.broadcast(before), "__p").withColumn(out, F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__b")


def backfill(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key and column the first value, by order, that isn't null or blank: key, name, value."""
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    first = rows.groupBy(key).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(f"__{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"__{i}").alias("value")) for i, c in enumerate(columns)])
    return first.select(key, F.explode(pairs).alias("x")).select(key, "x.name", "x.value").where("value is not null")


#: Columns of the flat log that belong to cases and offers: fixed values of the format.
CASE_COLUMNS = ["case:LoanGoal", "case:ApplicationType", "case:RequestedAmount"]
OFFER_COLUMNS = ["FirstWithdrawalAmount", "NumberOfTerms", "Accepted", "MonthlyCost", "Selected", "CreditScore", "OfferedAmount"]


def read_csv(spark: SparkSession, path: str) -> EventLog:
    """A flat log of applications: the case always, a work item or an offer by the event's origin. Rows without activity, time or case go.

    Events are named by their row in the file. A case has the attributes of its first row, an
    offer the first value of each attribute that isn't empty.
    """
    raw = numbered(spark.read.option("header", True).csv(path), "__row")
    c = lambda n: F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) if n in raw.columns else F.lit(None).cast("string")
    wide = [x for x in CASE_COLUMNS + OFFER_COLUMNS if x in raw.columns]
    rows = raw.select("__row", c("concept:name").alias("activity"), c("time:timestamp").alias("t"), c("case:concept:name").alias("case"), c("EventOrigin").alias("origin"), c("EventID").alias("event"), c("OfferID").alias("offer"), *[F.col(f"`{x}`") for x in wide])
    rows = rows.where("activity is not null and t is not null and `case` is not null").withColumn("eid", F.concat(F.lit("evt_"), "__row"))
    offer = F.coalesce("offer", F.when(F.col("event").startswith("Offer_"), F.col("event")))
    rows = rows.withColumn("offer", F.when(F.col("origin") == "Offer", offer))
    own = F.when((F.col("origin") == "Workflow") & F.col("event").isNotNull(), F.struct(F.col("event").alias("oid"), F.lit("Workflow").alias("otype"))).when(
        F.col("offer").isNotNull(), F.struct(F.col("offer").alias("oid"), F.lit("Offer").alias("otype"))
    )
    rows = rows.withColumn("obs", F.array_compact(F.array(F.struct(F.col("case").alias("oid"), F.lit("Application").alias("otype")), own)))
    objects = rows.select(F.explode("obs").alias("o")).select("o.*")
    of_case = rows.groupBy(F.col("case").alias("oid")).agg(F.min_by(F.array(*[F.struct(F.lit(x).alias("name"), F.col(f"`{x}`").alias("value")) for x in CASE_COLUMNS if x in wide]), "__row").alias("x")) if set(wide) & set(CASE_COLUMNS) else None
    parts = [of_case.select("oid", F.explode("x").alias("y")).select("oid", "y.*").where("value is not null")] if of_case is not None else []
    if set(wide) & set(OFFER_COLUMNS):
        parts.append(backfill(rows.where("offer is not null"), "offer", "__row", [x for x in OFFER_COLUMNS if x in wide]).withColumnRenamed("offer", "oid"))
    attributes = spark.createDataFrame([], "oid string, name string, value string")
    for part in parts:
        attributes = attributes.unionByName(part)
    links = spark.createDataFrame([], "src string, dst string, qualifier string")
    return _log(rows.select("eid", "activity", _us("t").alias("us"), F.col("obs.oid").alias("oids")), objects, links, object_attributes=attributes.withColumn("us", F.lit(None).cast("long")))


def from_traces(traces: DataFrame) -> EventLog:
    """Rows (case_no, trace array<string>): events are numbered over all traces in the order of the cases.

    Event k of case i is at 2024-01-01 plus i minutes plus k seconds. The numbering adds up
    trace lengths in blocks of 4096 cases, then the blocks' totals.
    """
    spark = traces.sparkSession
    sized = traces.select(F.col("case_no").cast("long").alias("case_no"), "trace", F.size("trace").cast("long").alias("n")).withColumn("block", F.floor(F.col("case_no") / 4096))
    blocks = sized.groupBy("block").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("block")) - F.col("n")).select("block", "before")
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("case_no")) - F.col("n")
    e = sized.withColumn("inside", inside).join(blocks, "block").select("case_no", (F.col("before") + F.col("inside")).alias("first"), F.posexplode("trace").alias("pos", "activity"))
    k = F.col("first") + F.col("pos")
    start = 1_704_067_200_000_000
    events = e.select(
        F.concat(F.lit("e_"), k).alias("eid"), "activity", (F.lit(start) + F.col("case_no") * 60_000_000 + k * 1_000_000).alias("us"), F.array(F.concat(F.lit("case_"), "case_no")).alias("oids")
    )
    objects = traces.select(F.concat(F.lit("case_"), F.col("case_no")).alias("oid"), F.lit("case").alias("otype"))
    return _log(events, objects, spark.createDataFrame([], "src string, dst string, qualifier string"))


def write_json(log: EventLog, path: str) -> None:
    """JSON lines, one an event or object, in the shape of version 2's list entries; a null time is refused."""
    if log.ev.where("us is null").limit(1).count():
        raise ValueError("an event has no time")
    rel = log.e2o.groupBy("eid").agg(F.array_sort(F.collect_list(F.struct(F.col("oid").alias("objectId")))).alias("relationships"))
    events = log.ev.join(rel, "eid", "left").select(F.struct(F.col("eid").alias("id"), F.col("activity").alias("type"), F.timestamp_micros("us").alias("time"), "relationships").alias("x"))
    links = log.o2o.groupBy(F.col("src").alias("oid")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("objectId"), "qualifier"))).alias("relationships"))
    objects = log.ob.join(links, "oid", "left").select(F.struct(F.col("oid").alias("id"), F.col("otype").alias("type"), "relationships").alias("x"))
    events.select(F.to_json("x").alias("value")).write.mode("errorifexists").text(f"{path}/events")
    objects.select(F.to_json("x").alias("value")).write.mode("errorifexists").text(f"{path}/objects")


_ENTITY = f"id string, type string, time string, attributes {_ATTR}, relationships {_REL}"


def _types_of(log: EventLog, attributes: DataFrame | None, entities: DataFrame, key: str, kind: str) -> list[dict]:
    """Types, by name, with the names of their entities' attributes. One row a type and name reaches the driver."""
    names = entities.select(F.col(kind).alias("type")).distinct().withColumn("name", F.lit(None).cast("string"))
    if attributes is not None:
        names = names.unionByName(entities.join(attributes, key).select(F.col(kind).alias("type"), "name").distinct())
    found: dict[str, list] = {}
    for r in sorted(map(tuple, names.collect()), key=repr):
        found.setdefault(r[0], []).extend([{"name": r[1], "type": "string"}] if r[1] is not None else [])
    return [{"name": t, "attributes": a} for t, a in sorted(found.items())]


def _iso(us: str) -> F.Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def write_document(log: EventLog, path: str, joined: str | None = None) -> None:
    """The log as one document of version 2, in parts that are written in parallel and follow each other by name.

    <path>/<section>/part-*: events by time and name, objects by name with the history of their
    attributes, an entity a line; the sections' parts, one after another, are the document. Lines
    start with the comma that parts them from the entity before, so parts don't depend on each other.
    joined: a file into which the parts' bytes are copied in that order, a buffer at a time; it is never
    held whole. A null time is refused.
    """
    spark = log.ev.sparkSession
    if log.ev.where("us is null").limit(1).count():
        raise ValueError("an event has no time")
    none = lambda key, rest: spark.createDataFrame([], f"{key} string, {rest}")
    eattr = log.event_attributes if log.event_attributes is not None else none("eid", "name string, value string")
    oattr = log.object_attributes if log.object_attributes is not None else none("oid", "name string, value string, us long")
    named = log.qualifiers if log.qualifiers is not None else none("eid", "oid string, qualifier string")
    start = log.ev.agg(F.min("us")).first()[0]
    together = lambda df, key, x, out: df.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias(out))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    e_rel = together(log.e2o.join(named, ["eid", "oid"], "left"), "eid", F.struct(F.col("oid").alias("objectId"), F.coalesce("qualifier", F.lit("")).alias("qualifier")), "relationships")
    e_att = together(eattr, "eid", F.struct("name", "value"), "attributes")
    events = log.ev.join(e_rel, "eid", "left").join(e_att, "eid", "left").select(
        "us", "eid", F.struct(F.col("eid").alias("id"), F.col("activity").alias("type"), _iso("us").alias("time"), empty(F.col("relationships"), "array<struct<objectId:string,qualifier:string>>").alias("relationships"), empty(F.col("attributes"), "array<struct<name:string,value:string>>").alias("attributes")).alias("x")
    )
    o_rel = together(log.o2o, F.col("src").alias("oid"), F.struct(F.col("dst").alias("objectId"), F.coalesce("qualifier", F.lit("")).alias("qualifier")), "relationships")
    o_att = together(oattr.withColumn("at", F.coalesce("us", F.lit(start))), "oid", F.struct("name", "at", _iso("at").alias("time"), "value"), "attributes")
    o_att = o_att.withColumn("attributes", F.transform("attributes", lambda a: F.struct(a["name"].alias("name"), a["time"].alias("time"), a["value"].alias("value"))))
    objects = log.ob.join(o_rel, "oid", "left").join(o_att, "oid", "left").select(
        "oid", F.struct(F.col("oid").alias("id"), F.col("otype").alias("type"), empty(F.col("attributes"), "array<struct<name:string,time:string,value:string>>").alias("attributes"), empty(F.col("relationships"), "array<struct<objectId:string,qualifier:string>>").alias("relationships")).alias("x")
    )
    head = {"version": "2.0", "ordering": "timestamp", "objectTypes": _types_of(log, log.object_attributes, log.ob, "oid", "otype"), "eventTypes": _types_of(log, log.event_attributes, log.ev, "eid", "activity")}
    line = lambda text: spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))

    def section(df: DataFrame, *order: str) -> DataFrame:
        first = df.agg(F.min(F.struct(*order)).alias("k"))
        comma = F.when(F.struct(*order) == F.col("k"), "").otherwise(",")
        lines = df.join(F.broadcast(first)).select(*order, F.concat(comma, F.to_json("x", {"ignoreNullFields": "false"})).alias("value"))  # first: one row
        return lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")

    sections = [
        ("0-head", line(json.dumps(head, ensure_ascii=False)[:-1] + ', "objects": [')), ("1-objects", section(objects, "oid")), ("2-between", line('], "events": [')), ("3-events", section(events, "us", "eid")), ("4-end", line("]}")),
    ]
    for name, df in sections:
        df.write.mode("errorifexists").text(f"{path}/{name}")
    if joined:
        _copied(spark, [f"{path}/{name}" for name, _ in sections], joined)


def _copied(spark: SparkSession, folders: list[str], target: str) -> None:
    """The part files of folders, by name, copied one after another into target, in any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    out = at(target).getFileSystem(conf).create(at(target), False)
    try:
        for folder in folders:
            store = at(folder).getFileSystem(conf)
            for p in sorted(str(s.getPath()) for s in store.listStatus(at(folder)) if s.getPath().getName().startswith("part-")):
                part = store.open(at(p))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()


def read_document(spark: SparkSession, path: str) -> EventLog:
    """A document as write_document writes it, its parts or the joined file: entities are lines, so tasks share even one file."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).where(r"value rlike '^,?[{]\"id\"'")
    x = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), _ENTITY).alias("x")).select("x.*")
    e, o = x.where("time is not null"), x.where("time is null")
    events = e.select(F.col("id").alias("eid"), F.col("type").alias("activity"), _us("time").alias("us"), F.col("relationships.objectId").alias("oids"))
    links = o.select(F.col("id").alias("src"), F.explode("relationships").alias("r")).select("src", F.col("r.objectId").alias("dst"), "r.qualifier")
    more = _details(e, o, "id", "id", F.col("relationships"), F.col("attributes"), F.col("attributes"), "name", "value", "time", "objectId", "qualifier")
    return _log(events, o.select(F.col("id").alias("oid"), F.col("type").alias("otype")), links, **more)


def write_tables(log: EventLog, path: str) -> None:
    """The relations as Parquet, the form to keep a large log in."""
    for name in ("ev", "ob", "e2o", "o2o"):
        getattr(log, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> EventLog:
    return EventLog(**{name: spark.read.parquet(f"{path}/{name}") for name in ("ev", "ob", "e2o", "o2o")})
