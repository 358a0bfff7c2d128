"""Queries of audits, attributes, graphs, runs, models and evaluation. The SQL they are compared with is written apart from them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import ctes, project
from ..registry import ORACLE, QUERIES
from ..sources import exploder, models
from ..storage import shared_dir
from ..streaming import monitors
from . import attributes, audits, evaluate, graph
from .arcs import MODEL, Arc

CLOSES = {"order": "Close Order"}


def query(sql: str):
    """Decorator: register f(spark, sf_dir) under its name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return wrap


# -- graphs

@query(f"""with {ctes('o')}, c as (select src as oid, dst as root from o2o where dst like 'customer_%'),
  p as (select oid, root from c union select oid, oid from ob where otype = 'customer'),
  l as (select oid, arg_max(activity, (us, eid)) as last from eo where otype = 'order' group by oid),
  s as (select p.root, max(eo.us) - min(eo.us) as span, count(*) as n, bool_or(coalesce(l.last = 'Close Order', false)) as closed from p join eo on eo.oid = p.oid left join l on l.oid = p.oid group by p.root)
  select round(avg(span / 1e6), 1) as mean_s, count(*) as n_traces from s where closed and n >= 2""")  # fmt: skip
def connected_trace_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined by their customers; parts and suppliers are resources. So each customer is a component, as the SQL says outright."""
    return graph.connected_trace_duration(project(spark, sf_dir, "o"), CLOSES, ("part", "supplier"))


@query(f"""with {ctes('u')}, n as (select src as oid, dst as other from o2o union select dst, src from o2o union select oid, oid from ob)
  select n.oid, ob.otype, count(*) as n from n join ob on ob.oid = n.other group by n.oid, ob.otype""")  # fmt: skip
def neighbors_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors_by_type(project(spark, sf_dir, "u"))


@query(f"""with {ctes('o')} select e.activity, count(*) as n_links, count(distinct o.src) as n_orders from (select distinct e2o.eid, o2o.dst from e2o join o2o on o2o.src = e2o.oid and o2o.dst like 'part_%' where e2o.otype = 'order') l
  join ev e on e.eid = l.eid left join (select eid, oid as src from e2o where otype = 'order') o on o.eid = l.eid group by e.activity""")  # fmt: skip
def transitive_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an event's orders contain, whether or not the event itself has them."""
    log = project(spark, sf_dir, "o")
    links = graph.transitive_objects(log, ("order", "part")).join(log.ev, "eid")
    own = log.e2o.where("otype = 'order'").select("eid", F.col("oid").alias("src"))
    return links.join(own, "eid", "left").groupBy("activity").agg(F.count("*").alias("n_links"), F.count_distinct("src").alias("n_orders"))


# -- audits

@query(f"""with {ctes('o')}, l as (select oid, count(*) as n, arg_max(activity, (us, eid)) as last from eo group by oid),
  x as (select ob.otype, coalesce(l.n, 0) as n, coalesce(ob.otype = 'order' and l.last = 'Close Order', false) as closed from ob left join l on l.oid = ob.oid),
  t as (select otype, count(*) as instances, count(*) filter (closed) as closed, count(*) filter (n = 0) as unused, min(n) as min_events, round(avg(n), 2) as mean_events, max(n) as max_events from x group by otype
    union all select 'invoice', 0, 0, 0, 0, 0.0, 0)
  select *, case when instances = 0 then 'under_created' when unused = instances then 'orphaned' when unused > 0 then 'partially_orphaned' when closed = 0 and instances > 1 then 'accumulating' else 'healthy' end as verdict from t""")  # fmt: skip
def lifecycle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.lifecycle_classes(project(spark, sf_dir, "o"), CLOSES, ("order", "part", "invoice"))


@query(f"""with {ctes('u')}, f as (select activity, eid, oid, row_number() over (partition by activity, oid order by us, eid) as r from eo),
  p as (select activity, eid, count(*) as k, max(case when r > 1 then 1 else 0 end) as again from f group by activity, eid),
  t as (select activity, count(*) as firings, min(k) as min_k, round(avg(k), 2) as mean_k, max(k) as max_k, case when count(*) > 1 then round(sum(again) / count(*), 3) else 0 end as reuse_rate from p group by activity),
  o as (select activity, count(*) as objects, max(n) as top from (select activity, oid, count(*) as n from eo group by activity, oid) group by activity)
  select t.activity, firings, objects, min_k, mean_k, max_k, reuse_rate, round(100.0 * top / firings, 1) as top_pct,
    case when objects = 1 and firings > 3 or top > 0.8 * firings and firings > 5 then 'object_starved' when reuse_rate > 0.9 and firings > 5 then 'high_reuse' else 'healthy' end as verdict from t join o on o.activity = t.activity
  union all select 'refund', 0, 0, 0, 0, 0, null, null, 'never_fired'""")  # fmt: skip
def participation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.participation_classes(project(spark, sf_dir, "u"), ("refund", "view"))


@query("""select * from (values ('refund', 'type_never_created', 'voucher'), ('refund', 'not_preceded', 'approve'), ('refund', 'no_transition', null), ('approve', 'creator_never_fired', 'claim'),
  ('approve', 'unlikely', null), ('review', 'no_object_at_hand', 'note'), ('ship', 'unknown', null)) t(activity, reason, what)""")  # fmt: skip
def never_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = audits.Needs
    model = {"view": n(("user",), ("note",)), "refund": n(("voucher", "user"), (), ("approve", "purchase")), "approve": n(("claim",)), "claim": n((), ("claim",)), "review": n(("note",)), "ship": n(("user",))}
    pairs = spark.createDataFrame([("view", "review"), ("view", "ship"), ("refund", "approve"), ("view", "claim")], "a string, b string")
    return audits.never_fired(project(spark, sf_dir, "u"), model, pairs).where("activity <> 'claim'")


@query(f"""with {ctes('o')}, l as (select oid, otype, arg_min(eid, (us, eid)) as eid, arg_max(activity, (us, eid)) as last, max(us) as done from eo where otype in ('order', 'customer') group by oid, otype),
  b as (select eid, bool_and(otype = 'order' and last = 'Close Order') as completed, max(done) as done from l group by eid),
  c as (select ev.activity as start, coalesce(b.completed, false) as completed, (b.done - ev.us) / 1e6 as d from ev left join b on b.eid = ev.eid where ev.activity = 'Place Order')
  select start, count(*) as n_cases, count(*) filter (completed) as n_completed, round(count(*) filter (completed) / count(*), 3) as completion_rate, round(avg(d), 1) as mean_s, round(min(d), 1) as min_s,
    round(max(d), 1) as max_s, round(median(d), 1) as median_s from c group by start""")  # fmt: skip
def case_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.case_statistics(project(spark, sf_dir, "o"), ("Place Order",), CLOSES, ("part", "supplier"))


# -- runs: the weeks of a log

_RUN_ARC = Arc("click", "purchase", "EF", each=("user",))


@query(f"""with {ctes('u')}, w as (select *, us // 604800000000 as run from ev),
  a as (select eid, run, exists (select 1 from eo y where y.oid = x.oid and y.activity = 'purchase' and y.us > x.us) as ok from (select eo.*, us // 604800000000 as run from eo where otype = 'user' and activity = 'click') x),
  v as (select run, 'events' as measure, count(*)::double as value from w group by run union all select run, 'objects', count(distinct oid) from w join e2o on e2o.eid = w.eid group by run
    union all select run, 'arc_0', count(*) filter (ok) / count(*) from a group by run)
  select measure, count(*) as n, round(avg(value), 2) as mean, round(stddev_pop(value), 2) as std, round(min(value), 6) as min, round(max(value), 6) as max from v group by measure""")  # fmt: skip
def multi_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = project(spark, sf_dir, "u")
    return audits.run_statistics(audits.run_values(log, F.floor(F.col("us") / 604_800_000_000), [_RUN_ARC])).withColumn("min", F.round("min", 6)).withColumn("max", F.round("max", 6))


@query(f"""with {ctes('u')}, l as (select oid, (max(us) - min(us)) / 1e6 as life from eo where otype = 'user' group by oid),
  a as (select activity, count(*) as n, avg(case when wait > 0 then wait else 0 end) as wait from (select x.activity, x.eid, (x.us - max(y.us)) / 1e6 as wait from eo x left join eo y on y.oid = x.oid and y.us < x.us where x.otype = 'user' group by x.activity, x.eid, x.us) q group by activity)
  select round((select sum(wait * n) / sum(n) from a), 1) as avg_wait_s, round((select avg(life) from l), 1) as avg_lifetime_s""") # fmt: skip
def run_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait of an event since its user's last strictly earlier one, weighted by executions, and users' mean lifetime."""
    from pyspark.sql import Window

    eo = project(spark, sf_dir, "u").eo.where("otype = 'user'")
    before = F.max("us").over(Window.partitionBy("oid").orderBy("us").rangeBetween(Window.unboundedPreceding, -1))
    waits = eo.withColumn("w", (F.col("us") - before) / 1e6).groupBy("activity", "eid").agg(F.min("w").alias("w"))
    per = waits.groupBy("activity").agg(F.count("*").alias("n"), F.avg(F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))).alias("wait"))
    lives = eo.groupBy("oid").agg(((F.max("us") - F.min("us")) / 1e6).alias("life"))
    return per.agg(F.round(F.sum(F.col("wait") * F.col("n")) / F.sum("n"), 1).alias("avg_wait_s")).crossJoin(lives.agg(F.round(F.avg("life"), 1).alias("avg_lifetime_s")))  # a row each


# -- attributes: a user's are the value and item of the last purchase

_LAST = "select 'user_' || user_id as oid, arg_max(value, (ts, event_id)) as spent, arg_max(props->>'$.k', (ts, event_id)) as item from events where event_type = 'purchase' group by user_id"


def _user_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    order = F.struct("ts", "event_id")
    one = e.groupBy(F.concat(F.lit("user_"), "user_id").alias("oid")).agg(F.max_by("value", order).cast("string").alias("spent"), F.max_by(F.get_json_object("props", "$.k"), order).alias("item"))
    return one.unpivot("oid", ["spent", "item"], "name", "value").where("value is not null")


@query(f"""with {ctes('u')}, l as ({_LAST}) select 'spent' as test, ob.oid from ob join l on l.oid = ob.oid where spent >= 50 union all select 'item', ob.oid from ob join l on l.oid = ob.oid where item <> 'x'
  union all select 'text', ob.oid from ob join l on l.oid = ob.oid where item < 'k'""")  # fmt: skip
def guard_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guard on numbers, one on texts, one where one side is no number, an unknown operator and an attribute that none has."""
    ob, at = project(spark, sf_dir, "u").ob, _user_attributes(spark, sf_dir)
    tests = [("spent", "spent", ">=", 50), ("item", "item", "!=", "x"), ("text", "item", "<", "k"), ("unknown", "spent", "~", 1), ("absent", "weight", "!=", 1)]
    out = None
    for name, attribute, op, value in tests:
        one = attributes.guarded(ob, at, attribute, op, value).select(F.lit(name).alias("test"), "oid")
        out = one if out is None else out.union(one)
    return out


@query("""with c as (select 'user_' || user_id as oid, ts, event_id, event_type as t from events where event_type in ('signup', 'click', 'error')), s as (select oid, max((ts, event_id)) as at from c where t = 'signup' group by oid)
  select c.oid, count(*) as n_changes, coalesce(any_value(case when s.oid is not null then 100 end), 0) + sum(case when s.oid is null or (c.ts, c.event_id) > s.at then case t when 'click' then 2 when 'error' then -1 else 0 end else 0 end) as value
  from c left join s on s.oid = c.oid group by c.oid""")  # fmt: skip
def attribute_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that a signup sets to 100, a click raises by 2 and an error lowers by 1: its last value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "click", "increment").when(F.col("event_type") == "error", "decrement")
    by = F.when(F.col("event_type") == "signup", 100.0).when(F.col("event_type") == "click", 2.0)
    made = e.select(F.concat(F.lit("user_"), "user_id").alias("oid"), F.lit("score").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("eid"), op.alias("op"), by.alias("value"))
    return attributes.changed(made).groupBy("oid").agg(F.count("*").alias("n_changes"), F.max_by("value", F.struct("us", "eid")).alias("value"))


# -- logs as texts

@query(f"with {ctes('c')} select ev.eid, ev.activity, cast(ev.us // 1000000 as varchar) as time, e2o.oid, e2o.otype from ev join e2o on e2o.eid = ev.eid")
def udtf_ocel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the JSON text of a log, taken apart again."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    oid = F.concat(F.lit("conv_"), "conv_id")
    event = F.struct(F.concat_ws("_", "conv_id", "turn").alias("id"), F.col("role").alias("type"), F.col("turn").cast("string").alias("time"), F.array(F.struct(oid.alias("objectId"))).alias("relationships"))
    texts = t.groupBy("conv_id").agg(F.to_json(F.struct(F.array(F.struct(F.first(oid).alias("id"), F.lit("conversation").alias("type"))).alias("objects"), F.collect_list(event).alias("events"))).alias("text"))
    return exploder.exploded(texts, "text")


# -- streams: the events table as a stream of files, taken to its end


@query("""with e as (select 'user_' || user_id as oid, event_type, epoch_us(ts) as us from events), w as (select max(us) - 7200000000 as mark from e where event_type in ('signup', 'purchase')),
  a as (select x.oid, x.us, min(y.us) as next from e x left join e y on y.oid = x.oid and y.event_type = 'purchase' and y.us > x.us where x.event_type = 'signup' group by x.oid, x.us)
  select oid, us as activation_us, case when next - us <= 86400000000 then next end as response_us, case when next - us <= 86400000000 then 'fulfilled' else 'violated' end as verdict from a cross join w
  where next is not null or us + 86400000000 < mark""")  # fmt: skip
def stream_monitor_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and whether a purchase of the user follows within a day; what is still open at the end has no row."""
    given = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(given).parquet(f"{sf_dir}/events.parque[t]")
    events = events.select(F.concat(F.lit("user_"), "user_id").alias("oid"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"))
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    verdicts = monitors.response_monitor(events.where("activity in ('signup', 'purchase')"), "signup", "purchase")
    verdicts.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/verdicts").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("oid string, activation_us long, response_us long, verdict string").parquet(f"{at}/verdicts")


# -- models

_FILES = {
    "arc": {"constraint_orientation": "arc", "constraints": [
        {"arc_type": "EF", "from": "A", "to": "B", "counts": [1, None], "involvement_per_label": {"order": "Each", "part": "any"}},
        {"arc_type": "EP", "from": "A", "to": "B", "counts": [1, 2], "scope": {"kind": "all", "object_type": "order"}},
        {"arc_type": "EF", "from": "A", "to": "C", "counts": [0, 0], "scope": {"bindings": [["order", "each"]]}},
        {"arc_type": "DP", "from": "B", "to": "B", "nmin": "2"}]},
    "kind": {"constraints": [
        {"type": "precedence", "source": "A", "target": "B", "scope": {"kind": "each", "object_type": "order"}},
        {"constraint_type": "direct_response", "source_activity": "A", "target_activity": "B", "nmin": 0, "nmax": 3, "guard": {"attribute": "x", "op": ">", "value": 1}},
        {"type": "not_succession", "a": "B", "b": "A"}, {"type": "coexistence", "source": "A", "target": "B", "nmin": 0, "nmax": 0}, {"type": "response", "source": "A"}]},
    "list": [
        {"from": "A", "to": "B", "arc_type": "DP", "counts": [1, 4], "label": {"each": [{"object_type": "order"}], "any": [{"object_type": "part"}]}},
        {"from": "A", "to": "B", "arc_type": "AS", "label": {"all": [{"object_type": "order"}]}},
        {"from": "B", "to": "B", "arc_type": "AS", "counts": [0, 0]}, {"from": "B", "arc_type": "AS"}],
}
#: What the entries read: form, number; kind, source, target, nmin, nmax; arc, src, tgt, lo, hi; labels, guarded.
_READ = """('arc', 0, 'response', 'A', 'B', 1, null, 'EF', 'A', 'B', 1, null, 'order:each,part:any', null),
  ('arc', 1, 'precedence', 'B', 'A', 1, 2, 'EP', 'A', 'B', 1, 2, 'order:all', null),
  ('arc', 2, 'not_succession', 'A', 'C', 0, null, 'EF', 'A', 'C', 0, 0, 'order:each', null),
  ('arc', 3, 'chain_precedence', 'B', 'B', 2, null, 'DP', 'B', 'B', 2, null, '', null),
  ('kind', 0, 'precedence', 'A', 'B', 1, null, 'EP', 'B', 'A', 1, null, 'order:each', null),
  ('kind', 1, 'chain_response', 'A', 'B', 0, 3, 'DF', 'A', 'B', 0, 3, '', true),
  ('kind', 2, 'not_succession', 'B', 'A', 0, null, 'EF', 'B', 'A', 0, 0, '', null),
  ('kind', 3, 'not_coexistence', 'A', 'B', 0, null, null, 'A', 'B', 0, 0, '', null),
  ('list', 0, 'chain_precedence', 'B', 'A', 1, 4, 'DP', 'A', 'B', 1, 4, 'order:each,part:any', null),
  ('list', 1, 'responded_existence', 'A', 'B', 1, null, 'AS', 'A', 'B', 1, null, 'order:all', null),
  ('list', 2, 'not_coexistence', 'B', 'B', 0, null, 'AS', 'B', 'B', 0, 0, '', null)"""


def _model_file(spark: SparkSession, form: str) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}/model"
    models.write_text(spark, json.dumps(_FILES[form]), path)
    return path


@query(f"select * from (values {_READ}) t(form, number, kind, source, target, nmin, nmax, arc, src, tgt, lo, hi, labels, guarded)")
def model_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for form in _FILES:
        one = models.constraints(spark, _model_file(spark, form)).withColumn("form", F.lit(form)).drop("support")
        out = one if out is None else out.union(one)
    return out.select("form", "number", "kind", "source", "target", "nmin", "nmax", "arc", "src", "tgt", "lo", "hi", "labels", F.when(F.col("guarded"), True).alias("guarded"))


@query("select * from (values ('text', 'A>C'), ('selfloop', 'B>A'), ('selfloop', 'B>B'), ('selfloop', 'A>B'), ('multi_response', 'A>B'), ('multi_response', 'B>B'), ('multi_response', 'B>B2')) t(test, pair)")
def constraint_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda *rows: spark.createDataFrame(list(rows), "kind string, source string, target string")
    loops = m(("response", "A", "B"), ("precedence", "B", "A"), ("response", "B", "B"), ("response", "A", "C"))
    many = m(("response", "A", "B"), ("chain_response", "B", "B"), ("precedence", "B", "B2"), ("response", "A", "D"))
    tests = [("text", models.filtered(loops, "c")), ("selfloop", models.filtered(loops, "", "selfloop")), ("multi_response", models.filtered(many, "b", "multi_response"))]
    out = None
    for name, frame in tests:
        one = frame.select(F.lit(name).alias("test"), F.concat_ws(">", "source", "target").alias("pair"))
        out = one if out is None else out.union(one)
    return out


# -- two logs in one call

EVALUATED = MODEL[:2]


def evaluate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evaluate_logs(project(spark, sf_dir, "u_reference"), project(spark, sf_dir, "u_simulated"), EVALUATED)[0]


def _followed(a: Arc) -> str:
    """eid, lo, hi of an arc's activations, by pairs of a user's events; {0} is the log's prefix."""
    when = {"EF": "y.us > x.us", "EP": "y.us < x.us"}[a.arc]
    return f"""select eid, min(n) as lo, max(n) as hi from (select x.eid, x.oid, count(y.eid) as n from {{0}}eo x left join {{0}}eo y on y.oid = x.oid and y.activity = '{a.tgt}' and {when}
      where x.activity = '{a.src}' and x.otype = '{a.each[0]}' group by x.eid, x.oid) b group by eid"""


def _conformance(role: str, z: str) -> list[str]:
    section = f"'conformance.{role}'"
    act = lambda a: f"(select count(*) from {z}ev where activity = '{a.src}')"
    out, bad = [], []
    scores = {c: [] for c in ("source_activation", "non_vacuous", "object_presence", "finite_boundary", "matching_event")}
    for i, a in enumerate(EVALUATED):
        f = f"({_followed(a).format(z)})"
        n = f"(select count(*) from {f} f where lo < {a.nmin})"
        bad.append(f"select eid from {f} f where lo < {a.nmin}")
        out += [f"select {section}, '{i}', 'activations', {act(a)}::double", f"select {section}, '{i}', 'violated', {n}::double", f"select {section}, '{i}', 'confidence', round(1 - {n} / {act(a)}, 6)"]
        counts = f"(select count(y.eid) as n from {z}eo x left join {z}eo y on y.oid = x.oid and y.activity = '{a.tgt}' and {'y.us > x.us' if a.arc == 'EF' else 'y.us < x.us'} where x.activity = '{a.src}' and x.otype = '{a.each[0]}' group by x.eid, x.oid)"
        scores["source_activation"].append(f"case when {act(a)} > 0 then 1.0 else 0 end")
        scores["non_vacuous"].append(f"case when (select count(*) from {f} f) > 0 then 1.0 else 0 end")
        scores["object_presence"].append(f"(select count(*) from {f} f) / {act(a)}")
        scores["finite_boundary"].append(f"(select count(*) filter (n = {a.nmin}) > 0 from {counts} c)::int::double")
        scores["matching_event"].append(f"(select count(*) filter (n > 0) > 0 from {counts} c)::int::double")
    out.append(f"select {section}, '', 'global_confidence', round(1 - (select count(distinct eid) from ({' union '.join(bad)}) b) / (select count(*) from {z}ev), 6)")
    acts = sorted({x for a in EVALUATED for x in (a.src, a.tgt)})
    out.append(f"select {section}, '', 'coverage_activity', round((select count(distinct activity) from {z}ev where activity in ({', '.join(map(repr, acts))})) / {len(acts)}, 6)")
    out.append(f"select {section}, '', 'coverage_object_type', (select count(distinct otype) from {z}ob where otype = 'user')::double")
    out += [f"select {section}, '', 'coverage_{c}', round(({' + '.join(xs)}) / {len(xs)}, 6)" for c, xs in scores.items()]
    return out


def _evaluated() -> str:
    parts = [f"select 'logs.{role}' as section, '' as item, '{what}' as measure, cast(count(*) as double) as value from ({rel}) q" for role, op in (("input", "<"), ("simulated", ">="))
             for what, rel in (("events", f"select 1 from events where ts {op} timestamp '2024-01-16'"), ("objects", f"select distinct user_id, 0 from events where ts {op} timestamp '2024-01-16' union all select distinct 0, cast(props->>'$.k' as bigint) from events where ts {op} timestamp '2024-01-16'"))]
    for section, name, of, columns in evaluate.SECTIONS:
        parts += [f"select '{section}', {of or chr(39) * 2}, '{c}', cast({c} as double) from ({ORACLE[name]}) q" for c in columns]
    parts += _conformance("input", "") + _conformance("simulated", "z_")
    return f"with {ctes('u_reference')}, {ctes('u_simulated', 'z_')} " + " union all ".join(parts)


QUERIES["evaluate_logs"] = evaluate_logs
ORACLE["evaluate_logs"] = _evaluated()
