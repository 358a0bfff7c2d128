"""Queries of the loaders over the test tables, and of small cases whose results are known."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import EventLog, ctes, project
from ..operators import mining
from ..operators.arcs import Arc, bindings
from ..registry import ORACLE, QUERIES
from ..storage import shared_dir
from . import loaders


def traces_to_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the log made of conversations as bare traces of roles."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    traces = turns.groupBy(F.col("conv_id").alias("case_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role).alias("trace"))
    return loaders.from_traces(traces).ev


QUERIES["traces_to_log"] = traces_to_log
ORACLE["traces_to_log"] = """select concat('e_', k) as eid, role as activity, 1704067200000000 + cast(conv_id as bigint) * 60000000 + k * 1000000 as us
  from (select conv_id, role, row_number() over (order by conv_id, turn, role) - 1 as k from conversations) x"""


def csv_backfill_first_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user the first item bought and the first value of all that isn't empty, as the flat loader fills offers in."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("oid"), "event_id", F.when(F.col("event_type") == "purchase", F.get_json_object("props", "$.k")).alias("bought"), F.get_json_object("props", "$.k").alias("seen"))
    return loaders.backfill(e, "oid", "event_id", ["bought", "seen"])


QUERIES["csv_backfill_first_nonnull"] = csv_backfill_first_nonnull
ORACLE["csv_backfill_first_nonnull"] = """with e as (select user_id as oid, event_id, case when event_type = 'purchase' then json_extract_string(props, '$.k') end as bought, json_extract_string(props, '$.k') as seen from events)
  select oid, 'bought' as name, arg_min(bought, event_id) as value from e where trim(bought) <> '' group by oid union all select oid, 'seen', arg_min(seen, event_id) from e where trim(seen) <> '' group by oid"""


def pair_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of activities and type: how many activations some, or each, object leads to the other activity."""
    found = mining.pair_supports(project(spark, sf_dir, "u")).where("src <> tgt")
    return found.select("otype", "src", "tgt", "total", *[f"{t}_{s}" for t in ("AS", "EF", "EP") for s in ("any", "each")])


QUERIES["pair_supports"] = pair_supports
ORACLE["pair_supports"] = f"""with {ctes('u')}, acts as (select distinct activity as tgt from ev),
  c as (select oid, activity as tgt, list_sort(list(us)) as at from eo group by oid, activity),
  n as (select x.otype, x.activity as src, x.eid, acts.tgt, coalesce(len(c.at), 0) > 0 as a, coalesce(c.at[-1] > x.us, false) as f, coalesce(c.at[1] < x.us, false) as p
    from eo x cross join acts left join c on c.oid = x.oid and c.tgt = acts.tgt where acts.tgt <> x.activity),
  e as (select otype, src, tgt, eid, bool_or(a) as a1, bool_and(a) as a2, bool_or(f) as f1, bool_and(f) as f2, bool_or(p) as p1, bool_and(p) as p2 from n group by otype, src, tgt, eid)
  select otype, src, tgt, count(*) as total, count(*) filter (a1) as AS_any, count(*) filter (a2) as AS_each, count(*) filter (f1) as EF_any, count(*) filter (f2) as EF_each, count(*) filter (p1) as EP_any, count(*) filter (p2) as EP_each
  from e group by otype, src, tgt"""


def ocel_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of users as one document, written in parts and read back: each event with how many objects it has."""
    log = project(spark, sf_dir, "u")
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("eid"), F.lit("value").alias("name"), F.format_string("%.2f", "value").alias("value"))
    log.event_attributes = values
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    loaders.write_document(log, f"{at}/parts", f"{at}/log.json")
    back = loaders.read_document(spark, f"{at}/log.json")
    n = back.e2o.groupBy("eid").agg(F.count("*").alias("n_objects"))
    return back.ev.join(n, "eid", "left").join(back.event_attributes.select("eid", "value"), "eid", "left").select("eid", "activity", "us", "n_objects", "value")


QUERIES["ocel_document"] = ocel_document
ORACLE["ocel_document"] = f"""with {ctes('u')}, n as (select eid, count(distinct oid) as n_objects from e2o group by eid) select ev.*, n.n_objects, printf('%.2f', e.value) as value from ev left join n on n.eid = ev.eid join events e on cast(e.event_id as varchar) = ev.eid"""


#: Case, arc, events (name, activity, time, objects; c is of type C, v of V), and how many targets each binding has.
CASES = [
    ("each_each", Arc("A", "B", "EF", each=("C", "V")), "a,A,1,c1 c2 v1 v2; b1,B,2,c1 v1; b2,B,3,c2 v2", "0,0,1,1"),
    ("all", Arc("A", "B", "EF", all_=("C",)), "a,A,1,c1 c2; b1,B,2,c1; b2,B,3,c1 c2", "1"),
    ("any", Arc("A", "B", "EF", any_=("C",)), "a,A,1,c1 c2; b1,B,2,c1; b2,B,3,c2", "2"),
    ("direct_ties", Arc("A", "B", "DF", each=("C",)), "a,A,1,c1; b1,B,3,c1; b2,B,3,c1", "2"),
    ("direct_hidden", Arc("A", "B", "DF", each=("C",)), "a,A,1,c1; x,D,2,c1; b1,B,3,c1", "0"),
    ("simultaneous", Arc("A", "B", "EF", each=("C",)), "a,A,2,c1; b,B,2,c1", "0"),
    ("precedes", Arc("B", "A", "EP", each=("C",)), "a,A,1,c1; b1,B,2,c1; b2,B,3,c1", "1,1"),
    ("each_any", Arc("A", "B", "AS", each=("C",), any_=("V",)), "a,A,1,c1 v1 v2; b1,B,2,c1 v2; b2,B,3,c1; b3,B,4,v1", "1"),
]


def small_log(spark: SparkSession, text: str) -> EventLog:
    rows = [x.strip().split(",") for x in text.split(";")]
    links = sorted({(e, o, o[0].upper()) for e, _, _, os in rows for o in os.split()})
    return EventLog(
        spark.createDataFrame([(e, a, int(t)) for e, a, t, _ in rows], "eid string, activity string, us long"), spark.createDataFrame(sorted({(o, t) for _, o, t in links}), "oid string, otype string"),
        spark.createDataFrame(links, "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )


def arc_unit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, arc, events, _ in CASES:
        one = bindings(small_log(spark, events), arc).agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("counts")).select(F.lit(name).alias("name"), "counts")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["arc_unit_cases"] = arc_unit_cases
ORACLE["arc_unit_cases"] = "select * from (values " + ", ".join(f"('{n}', '{c}')" for n, _, _, c in CASES) + ") t(name, counts)"

_E = lambda a, b, arc="EF", each=("C",), **k: Arc(a, b, arc, each=each, **k)
#: Arcs, and which of them (by number) are left.
IMPLIED = [_E("A", "B", each=(), any_=("C",)), _E("A", "B"), _E("A", "B", each=("C", "V")), _E("A", "B", "DF"), _E("B", "A")]
CHAIN = [_E("A", "B"), _E("B", "C"), _E("A", "C"), _E("A", "C", each=("V",)), _E("C", "A", "EP")]


def _left(arcs: list[Arc], reduce):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = {a for a, _ in reduce([(a, 1.0) for a in arcs])}
        return spark.createDataFrame([(i, a in kept) for i, a in enumerate(arcs)], "number int, kept boolean")

    return query


QUERIES["reduce_implied"] = _left(IMPLIED, mining.reduce_implied)
ORACLE["reduce_implied"] = "select * from (values (0, false), (1, false), (2, true), (3, true), (4, true)) t(number, kept)"
QUERIES["lossless_reduction"] = _left(CHAIN, mining.lossless)
ORACLE["lossless_reduction"] = "select * from (values (0, true), (1, true), (2, false), (3, true), (4, true)) t(number, kept)"
