"""Timing, object-centric pattern measures, audits, and comparison of two logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..log import RELATIONS, EventLog, project
from ..plans import cuts
from ..registry import ORACLE, QUERIES, add, comparison, doubles, duck_sql, operator

#: eid, activity, flow, sojourn, sync (seconds, null where undefined), direct service samples aside.
_TIMES = """select eid, activity, max(us) as us,
  case when max(prev) is null then 0.0 else greatest(0, (max(us) - max(prev)) / 1e6) end as sojourn,
  case when max(prev) is null then 0.0 else greatest(0, (max(us) - min(prev)) / 1e6) end as flow,
  case when max(prev) is null then null else greatest(0, (max(prev) - min(prev)) / 1e6) end as sync
  from (select eid, activity, us, prev_us as prev from {seq}) x group by eid, activity"""
_DIRECT = "select activity, greatest(0, (next_us - us) / 1e6) as v from {seq} x where next_us is not null"
_SAMPLES = {"min": "1", "p25": "cast(ceil(0.25 * n) as bigint)", "p50": "cast(ceil(0.5 * n) as bigint)", "all": "n"}


def chosen_samples(mode: str) -> str:
    """activity, source, v, w: the samples of service time, by the rule of medians, lowest part only; w: how many samples have this value.

    The samples of an activity are of three kinds: to the next event (f), positive sojourns
    (p), other sojourns (z). All are counted and ordered in one go, and one kind is chosen.
    """
    samples = f"select concat('f', activity) as k, v from ({_DIRECT}) direct union all select concat(case when sojourn > 0 then 'p' else 'z' end, activity), sojourn from ({_TIMES}) times"
    counted = cuts.cumulated("k", f"(select k, v, count(*) as x from ({samples}) r group by k, v)", "x")
    middle = lambda kind: f"max(case when substr(k, 1, 1) = '{kind}' and c_x - x < floor(n_x / 2.0) + 1 and c_x >= floor(n_x / 2.0) + 1 then v end)"
    return f"""with c as (select k, v, x, c_x, n_x as n, n_x from {counted} q),
      m as (select substr(k, 2) as activity, {middle('f')} as f, {middle('p')} as p from c group by substr(k, 2)),
      s as (select activity, case when f is not null and (p is null or f <= p) then 'f' when p is not null then 'p' else 'z' end as kind from m),
      o as (select s.activity, s.kind, c.v, c.x, c.c_x - c.x as before, greatest(1, {_SAMPLES[mode]}) as most from c join s on c.k = concat(s.kind, s.activity))
      select activity, case kind when 'f' then 'forward' when 'p' then 'positive_sojourn' else 'zero_or_empty_sojourn' end as source, v, cast(least(x, most - before) as bigint) as w from o where before < most"""


@operator("u", mode="p25")
def service_times(d, mode):
    return f"""with c as ({chosen_samples(mode)}), m as (select activity, sum(v * w) / sum(w) as mean from c group by activity)
      select c.activity, max(c.source) as source, cast(sum(c.w) as bigint) as n, round(max(m.mean), 6) as mean_s, round(sqrt(sum(c.w * (c.v - m.mean) * (c.v - m.mean)) / sum(c.w)), 6) as std_s, min(c.v) as min_s, max(c.v) as max_s
      from c join m on m.activity = c.activity group by c.activity"""


add("timing_window", "u", lambda d: f"select activity, cast(sum(w) as bigint) as n, max(v) as highest from ({chosen_samples('p50')}) c group by activity")


@operator("u", mode="p25")
def ocpa_metrics(d, mode):
    """Per activity: means and deviations of flow, sojourn, synchronisation (pooling equals it and lagging is 0 by their formulas), service, waiting."""
    return f"""select t.activity, t.n, round(t.flow, 6) as flow_mean, round(t.sojourn, 6) as sojourn_mean, round(t.sojourn_std, 6) as waiting_std, round(t.sync, 6) as sync_mean, round(t.sync, 6) as pooling_mean,
      case when t.sync is null then null else 0.0 end as lagging_mean, round(s.mean_v, 6) as service_mean, round(greatest(0, t.sojourn - s.mean_v), 6) as waiting_mean
      from (select activity, count(*) as n, avg(flow) as flow, avg(sojourn) as sojourn, stddev_pop(sojourn) as sojourn_std, avg(sync) as sync from ({_TIMES}) x group by activity) t
      left join (select activity, sum(v * w) / sum(w) as mean_v from ({chosen_samples(mode)}) c group by activity) s on s.activity = t.activity"""


@operator("u", mode="p25", safety=1.0)
def activity_concurrency(d, mode, safety):
    """Peak of instances at work, each from its event on for the activity's measured mean service; 1 where that is 0 or unknown."""
    mean = f"select activity, sum(v * w) / sum(w) as mean from ({chosen_samples(mode)}) c group by activity"
    spans = f"select e.activity, e.us as a, e.us + cast(round(m.mean * 1000000.0) as bigint) as b from {{ev}} e join ({mean}) m on m.activity = e.activity where m.mean > 0"
    return f"select a.activity, cast(greatest(1, ceil(coalesce(x.peak, 1) * {safety})) as bigint) as peak from (select distinct activity from {{ev}}) a left join {cuts.peak('activity', spans)} x on x.activity = a.activity"


@operator("u", "service_anchors", mode="p25", anchors=(("view", 120.0, 30.0, 10.0, None), ("refund", 60.0, 5.0, 0.0, 90.0)))
def service_anchors(d, mode, anchors):
    """Service times where some activities have given ones (activity, mean, std, min, max): these replace the measured ones of activities in the log, with no samples."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    given = " union all ".join(f"select {q(a)} as activity, 'anchor' as source, cast(0 as bigint) as n, cast({m} as double) as mean_s, cast({s} as double) as std_s, cast({lo} as double) as min_s, cast({'null' if hi is None else hi} as double) as max_s" for a, m, s, lo, hi in anchors)
    measured = f"select activity, source, n, mean_s, std_s, min_s, max_s from ({service_times.write(d, mode)}) m where activity not in ({', '.join(q(x[0]) for x in anchors)})"
    return f"select * from ({measured}) m union all select g.* from ({given}) g where g.activity in (select distinct activity from {{ev}})"


def service_estimate(log: EventLog, mode: str = "p50") -> DataFrame:
    """activity, estimate: the mean service time, by an aggregate in Python over ranges of values.

    A range's state is two numbers; a range holds distinct values with their counts, and salts split it
    further, so no group of the aggregate grows with an activity's events.
    """

    @F.pandas_udf("array<double>")
    def weighted_sums(v: pd.Series, w: pd.Series) -> list:
        return [float((v * w).sum()), float(w.sum())]

    samples = log.sql(doubles(chosen_samples(mode)))
    part = F.pmod(F.xxhash64("v"), F.lit(64))
    partial = samples.groupBy("activity", part.alias("part")).agg(weighted_sums("v", F.col("w").cast("double")).alias("s"))
    return partial.groupBy("activity").agg(F.round(F.sum(F.get("s", F.lit(0))) / F.sum(F.get("s", F.lit(1))), 6).alias("estimate"))


def udaf_service_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return service_estimate(project(spark, sf_dir, "u"))


QUERIES["udaf_service_estimate"] = udaf_service_estimate
ORACLE["udaf_service_estimate"] = duck_sql(doubles(f"select activity, round(sum(v * w) / sum(w), 6) as estimate from ({chosen_samples('p50')}) c group by activity"), "u")


@operator("u")
def ocpq_measures(d):
    """For consecutive events of one object with different activities: distinct event pairs and their shares, throughput, class of types."""
    return f"""with c as (select otype, oid, eid as e1, activity as s, us as u1, next_eid as e2, next_activity as t, next_us as u2 from {{seq}}),
      p as (select * from c where t is not null and t <> s),
      n as (select activity, count(*) as n from {{ev}} group by activity),
      m as (select s, t, count(distinct concat(e1, '>', e2)) as support, count(distinct e1) as n_src, count(distinct e2) as n_tgt, avg((u2 - u1) / 1e6) as thr, {d.join_distinct('otype', '|')} as types from p group by s, t),
      o as (select s, sum(support) as total from m group by s), i as (select t, sum(support) as total from m group by t)
      select m.s, m.t, m.support, round(m.n_src * 1.0 / a.n, 4) as coverage, round(m.support * 1.0 / o.total, 4) as selectivity, round(m.n_tgt * 1.0 / b.n, 4) as reach, round(m.support * 1.0 / i.total, 4) as exclusivity,
      round(m.thr, 1) as throughput_s, m.types, substr(md5(concat(m.s, '>', m.t)), 1, 8) as eq_class
      from m join n a on a.activity = m.s join n b on b.activity = m.t join o on o.s = m.s join i on i.t = m.t"""


@operator("u")
def object_metrics(d):
    return "select oid, otype, min(us) as first_us, max(us) as last_us, (max(us) - min(us)) / 1e6 as lifetime_s, count(*) as n_events, count(distinct activity) as n_activities from {eo} group by oid, otype"


@operator("u")
def participation_audit(d):
    return """with f as (select activity, eid, oid, case when lag(eid) over (partition by activity, oid order by us, eid) is null then 0 else 1 end as again from {eo}),
      a as (select activity, count(distinct eid) as firings, count(distinct oid) as objects, count(*) as links, sum(again) as reused from f group by activity),
      t as (select activity, max(n) as top from (select activity, oid, count(*) as n from {eo} group by activity, oid) x group by activity)
      select a.activity, a.firings, a.objects, round(a.links * 1.0 / a.firings, 3) as per_firing, round(a.reused * 1.0 / a.links, 4) as reuse_rate, case when t.top > 0.8 * a.firings then true else false end as dominated,
      case when a.firings = 0 then 'never_fired' when a.reused > 0.8 * a.links then 'high_reuse' else 'healthy' end as verdict from a join t on a.activity = t.activity"""


@operator("o")
def lifecycle_audit(d):
    return """with u as (select o.otype, o.oid, min(e.us) as first_us, max(e.us) as last_us from {ob} o left join {eo} e on o.oid = e.oid group by o.otype, o.oid)
      select otype, count(*) as declared, count(first_us) as used, case when count(first_us) = 0 then 'orphaned' when count(first_us) < count(*) then 'partially_orphaned' else 'healthy' end as verdict from u group by otype"""


@operator("o", src="order", dst="part", lo=2, hi=5, examples=20)
def o2o_audit(d, src, dst, lo, hi, examples):
    """Objects with fewer or more partners than a rule allows, with the first examples by name."""
    return f"""with n as (select o.oid, count(distinct l.dst) as k from {{ob}} o left join (select l.src, l.dst from {{o2o}} l join {{ob}} b on l.dst = b.oid and b.otype = '{dst}') l on l.src = o.oid where o.otype = '{src}' group by o.oid),
      v as (select oid, case when k < {lo} then 'below' else 'above' end as fault from n where k < {lo} or k > {hi}),
      c as (select fault, count(*) as n from v group by fault),
      f as (select oid, fault from (select oid, fault, row_number() over (partition by fault, substr(md5(oid), 1, 2) order by oid) as r from v) x where r <= {examples}),
      e as (select fault, oid from (select fault, oid, row_number() over (partition by fault order by oid) as r from f) x where r <= {examples})
      select c.fault, max(c.n) as n, {d.join('e.oid', ',', 'e.oid')} as examples from c join e on e.fault = c.fault group by c.fault"""


_KEYS = "(select activity, sum(a) as a, sum(b) as b from (select activity, count(*) as a, 0 as b from {ev} group by activity union all select activity, 0, count(*) from {z_ev} group by activity) u group by activity)"


def _kl(rel: str, key: str, smooth: float, log: str) -> str:
    return f"""with k as (select {key}, a + {smooth} as a, b + {smooth} as b from {rel} q), t as (select sum(a) as ta, sum(b) as tb from k)
      select round(sum(a / ta * {log}((a / ta) / (b / tb))), 6) as kl_forward, round(sum(b / tb * {log}((b / tb) / (a / ta))), 6) as kl_backward from k cross join t"""


@comparison("kl_activity")
def kl_activity(d):
    return _kl(_KEYS, "activity", 0.5, "log2")


@comparison("kl_laplace")
def kl_laplace(d):
    return _kl(_KEYS, "activity", 1.0, "ln")


@comparison("kl_objects")
def kl_objects(d):
    rel = "(select otype, sum(a) as a, sum(b) as b from (select otype, count(*) as a, 0 as b from {ob} group by otype union all select otype, 0, count(*) from {z_ob} group by otype) u group by otype)"
    return _kl(rel, "otype", 0.5, "log2")


@comparison("object_counts")
def object_counts(d):
    return "select otype, cast(sum(a) as bigint) as n_reference, cast(sum(b) as bigint) as n_simulated from (select otype, count(*) as a, 0 as b from {ob} group by otype union all select otype, 0, count(*) from {z_ob} group by otype) u group by otype"


@comparison("only_in_reference")
def only_in_reference(d):
    return "select x.oid, x.otype from {ob} x left join {z_ob} z on x.oid = z.oid where z.oid is null"


@comparison("types_union")
def types_union(d):
    return "select otype from {ob} union select otype from {z_ob}"


@comparison("types_intersect")
def types_intersect(d):
    return "select otype from {ob} intersect select otype from {z_ob}"


@comparison("types_except")
def types_except(d):
    return "select otype from {ob} except select otype from {z_ob}"


def _z(sql: str) -> str:
    for r in RELATIONS:
        sql = sql.replace("{" + r + "}", "{z_" + r + "}")
    return sql


def _area(a: str, b: str, out: str) -> str:
    """Area between, and largest difference of, the distribution functions of v for each activity."""
    p = f"(select activity, v, sum(x) as x, sum(y) as y from (select activity, v, 1 as x, 0 as y from ({a}) a union all select activity, v, 0, 1 from ({b}) b) u group by activity, v)"
    return f"""with c as (select activity, v, c_x as cx, c_y as cy, n_x as nx, n_y as ny, nv from {cuts.cumulated('activity', p, 'x', 'y')} w)
      {out}"""


_W1 = "select activity, max(nx) as n_reference, max(ny) as n_simulated, round(sum(abs(cx * 1.0 / nx - cy * 1.0 / ny) * coalesce(nv - v, 0)), 6) as w1 from c where nx > 0 and ny > 0 group by activity"
_KS = "select activity, round(max(abs(cx * 1.0 / nx - cy * 1.0 / ny)), 4) as ks from c where nx > 0 and ny > 0 group by activity"
_HOURS = f"select activity, v / 3600.0 as v from ({_DIRECT}) h"
_BACK = "select activity, gap as v from (select activity, eid, (us - max(prev)) / 1e6 as gap from (select activity, eid, us, prev_us as prev from {seq}) x group by activity, eid, us) y where gap >= 0 and gap < 365 * 86400.0"


@comparison("wasserstein")
def wasserstein(d):
    return _area(_HOURS, _z(_HOURS), _W1.replace("max(nx) as n_reference, max(ny) as n_simulated", "cast(max(nx) as bigint) as n_reference, cast(max(ny) as bigint) as n_simulated"))


@comparison("w1_sojourn")
def w1_sojourn(d):
    return _area(_BACK, _z(_BACK), "select activity, case when count(*) < 2 then 0.0 else round(sum(abs(cx * 1.0 / nx - cy * 1.0 / ny) * coalesce(nv - v, 0)), 2) end as w1 from c where nx > 0 and ny > 0 group by activity")


@comparison("ks_sojourn")
def ks_sojourn(d):
    return _area(_BACK, _z(_BACK), _KS)


@comparison("emd_gaps")
def emd_gaps(d):
    g = f"select activity, gap / 1e6 as v from {cuts.gaps('activity', '{ev}')} g"
    return _area(g, _z(g), "select activity, round(sum(abs(cx * 1.0 / nx - cy * 1.0 / ny) * coalesce(nv - v, 0)), 4) as emd from c where nx > 0 and ny > 0 group by activity")


@comparison("wmape")
def wmape(d):
    s = f"select activity, avg(v) as m, stddev_pop(v) as s from ({_HOURS}) q group by activity"
    return f"select round(sum(abs(a.m - b.m)) / nullif(sum(abs(a.m)), 0), 6) as wmape_mean, round(sum(abs(a.s - b.s)) / nullif(sum(abs(a.s)), 0), 6) as wmape_std from ({s}) a join ({_z(s)}) b on a.activity = b.activity"


def ngd(d, n):
    """Half the sum of differences of n-gram shares, for each type and over all."""
    from .params import ngrams

    g = ngrams(d, n)
    pool = lambda x: f"select otype, gram, n from ({x}) a union all select 'all', gram, sum(n) from ({x}) b group by gram"
    return f"""with k as (select otype, gram, sum(a) as a, sum(b) as b from (select otype, gram, n as a, 0 as b from ({pool(g)}) p union all select otype, gram, 0, n from ({pool(_z(g))}) q) u group by otype, gram),
      t as (select otype, sum(a) as ta, sum(b) as tb from k group by otype)
      select k.otype, round(sum(abs(k.a * 1.0 / t.ta - k.b * 1.0 / t.tb)) / 2.0, 6) as ngd from k join t on k.otype = t.otype where t.ta > 0 and t.tb > 0 group by k.otype"""


for _n in (2, 3):
    add(f"ngd_{_n}", "u_reference", ngd, other="u_simulated", n=_n)


@comparison("cardinality_fidelity")
def cardinality_fidelity(d):
    s = "select activity, avg(n) as m, stddev_pop(n) as s, min(n) as lo, max(n) as hi from (select activity, eid, count(*) as n from {eo} group by activity, eid) q group by activity"
    return f"select coalesce(a.activity, b.activity) as activity, round(a.m, 3) as mean_reference, round(b.m, 3) as mean_simulated, round(a.s, 3) as std_reference, round(b.s, 3) as std_simulated, round(abs(a.m - b.m), 3) as mean_diff from ({s}) a full outer join ({_z(s)}) b on a.activity = b.activity"


@comparison("log_fidelity")
def log_fidelity(d):
    return f"select activity, cast(a as bigint) as n_reference, cast(b as bigint) as n_simulated, round(a * 1.0 / sum(a) over () - b * 1.0 / sum(b) over (), 6) as share_diff from {_KEYS} k"


@comparison("ocpa_comparison")
def ocpa_comparison(d):
    s = f"select activity, avg(flow) as flow, avg(sojourn) as sojourn, avg(sync) as sync from ({_TIMES}) x group by activity"
    one = lambda f: f"select a.activity, '{f}' as measure, round(a.{f}, 6) as reference, round(b.{f}, 6) as simulated, round(100.0 * (b.{f} - a.{f}) / nullif(a.{f}, 0), 1) as pct from ({s}) a join ({_z(s)}) b on a.activity = b.activity"
    return " union all ".join(one(f) for f in ("flow", "sojourn", "sync"))
