"""Process parameters measured from a log: counts, bindings, lifecycles, transitions, times."""

from __future__ import annotations

from ..plans import cuts
from ..registry import add, operator


def sums_before(d, source: str, count: str, rest: str) -> str:
    """Rows of source with b_<count>, the sum over the object's rows before; cut by days in Spark, one plain window for comparison."""
    if d.name == "duck":
        return f"(select oid, us, eid, {rest}, coalesce(sum({count}) over (partition by oid order by us, eid rows between unbounded preceding and 1 preceding), 0) as b_{count} from {source} s0)"
    return cuts.before("oid", source, count, rest=rest)


@operator("o")
def object_types(d):
    return "select distinct otype from {ob} where otype <> ''"


@operator("u")
def activities(d):
    return "select distinct activity from {ev} where activity <> ''"


@operator("u")
def activity_counts(d):
    return "select activity, count(*) as n from {ev} group by activity"


@operator("o")
def object_type_counts(d):
    return "select otype, count(*) as n from {ob} group by otype"


@operator("o")
def e2o_typed(d):
    return "select activity, otype, count(*) as n_links, count(distinct oid) as n_objects from {eo} group by activity, otype"


@operator("u")
def events_light(d):
    return f"select e.eid, e.activity, e.us, {d.join('x.oid', ',', 'x.oid')} as object_ids from {{ev}} e join {{e2o}} x on e.eid = x.eid group by e.eid, e.activity, e.us"


@operator("u")
def log_time_range(d):
    return "select min(us) as first_us, max(us) as last_us, round(case when count(*) < 2 then null else (max(us) - min(us)) / 1e6 end, 1) as span_s from {ev}"


@operator("u")
def traces_global(d):
    """One trace of all activities by time, as rows with the activity before (a trace of the whole log is no single value at scale). Ordered within minutes."""
    rows = cuts.before("k", "(select 1 as k, us, eid, activity from {ev})", rest="activity", last="activity", width=cuts.MINUTE)
    return f"select activity, eid, us, prev as previous from {rows} b"


@operator("c", otype="conversation")
def traces_by_type(d, otype):
    return f"select oid, {d.join('activity', ' ', 'us', 'eid')} as trace from {{eo}} where otype = '{otype}' group by oid"


@operator("c")
def object_traces(d):
    return f"select otype, oid, count(*) as n, {d.join('activity', '>', 'us', 'eid')} as trace from {{eo}} group by otype, oid"


@operator("o")
def max_objects_per_event(d):
    return "select activity, otype, max(n) as max_n from (select activity, eid, otype, count(*) as n from {eo} group by activity, eid, otype) x group by activity, otype"


@operator("o")
def object_bindings(d, unbounded=100):
    return f"select activity, otype, min(n) as min_n, case when max(n) < {unbounded} then max(n) end as max_n from (select activity, eid, otype, count(*) as n from {{eo}} group by activity, eid, otype) x group by activity, otype"


@operator("u")
def occurrences_per_object(d):
    return "select activity, otype, min(n) as min_n, max(n) as max_n, count(*) as n_objects from (select activity, otype, oid, count(*) as n from {eo} group by activity, otype, oid) x group by activity, otype"


@operator("u", left="user", right="item")
def joint_occurrences(d, left, right):
    return f"select activity, min(n) as min_n, max(n) as max_n, count(*) as n_pairs from (select a.activity, a.oid, b.oid as oid2, count(*) as n from {{eo}} a join {{e2o}} b on a.eid = b.eid and b.otype = '{right}' where a.otype = '{left}' group by a.activity, a.oid, b.oid) x group by activity"


@operator("u")
def activity_repeat_stats(d):
    return "select activity, min(n) as min_n, max(n) as max_n, round(avg(n), 2) as mean_n from (select activity, oid, count(*) as n from {eo} group by activity, oid) x group by activity"


@operator("u")
def interarrival(d):
    return f"""select activity, count(gap) as n, round(avg(gap), 6) as mean_s, round(stddev_pop(gap), 6) as std_s, min(gap) as min_s, max(gap) as max_s,
      case when avg(gap) > 0 then 'exponential' else 'fixed' end as dist from (select activity, gap / 1e6 as gap from {cuts.gaps('activity', '{ev}')} g) x group by activity"""


@operator("u")
def calendar_slots(d):
    """Slot 24 * weekday + hour (Monday first): share of ISO weeks with an event of the activity in it; all 168 slots of each activity."""
    day = "cast(floor(us / 86400000000.0) as bigint)"
    return f"""with e as (select activity, (({day} + 3) % 7) * 24 + cast(floor(us / 3600000000.0) as bigint) % 24 as slot, cast(floor(({day} + 3) / 7.0) as bigint) as week from {{ev}}),
      w as (select count(distinct week) as weeks from e),
      n as (select activity, slot, count(distinct week) as k from e group by activity, slot),
      s as (select activity, cast(n as bigint) as slot from (select distinct activity from e) a cross join {d.numbers('0', '167')} z)
      select s.activity, s.slot, round(coalesce(n.k, 0) * 1.0 / w.weeks, 6) as share from s cross join w left join n on n.activity = s.activity and n.slot = s.slot"""


@operator("u", safety=1.0)
def wip_peak(d, safety):
    spans = "select otype, min(us) as a, max(us) as b from {eo} group by otype, oid"
    return f"select otype, cast(peak as bigint) as peak, cast(greatest(1, ceil(peak * {safety})) as bigint) as cap from {cuts.peak('otype', spans)} x where peak > 0"


def _ends(d, which: str, threshold: float) -> str:
    edge = d.earliest if which == "creates" else d.latest
    return f"""select f.otype, f.activity, f.n, round(f.n * 1.0 / t.n, 6) as share from
      (select otype, activity, count(*) as n from (select otype, oid, {edge('activity', 'us', 'eid')} as activity from {{eo}} group by otype, oid) x group by otype, activity) f
      join (select otype, count(*) as n from {{ob}} group by otype) t on f.otype = t.otype where f.n >= {threshold} * t.n"""


@operator("o", threshold=0.5)
def lifecycle_creates(d, threshold):
    return _ends(d, "creates", threshold)


@operator("o", threshold=0.5)
def lifecycle_deactivates(d, threshold):
    return _ends(d, "deactivates", threshold)


_REUSE = """select o.otype, avg(coalesce(m.n, 0)) as score from {ob} o left join (select oid, max(n) as n from (select oid, activity, count(*) as n from {eo} group by oid, activity) x group by oid) m on o.oid = m.oid group by o.otype"""


@operator("o", threshold=2.0)
def permanent_types(d, threshold):
    return f"select otype, round(score, 6) as score from ({_REUSE}) s where score >= {threshold}"


@operator("o")
def permanent_threshold(d, ratio=3.0):
    """The middle (geometric) of the widest gap between the types' scores; null if there are fewer than two or the gap is small."""
    return f"""select case when max(n) < 2 or max(gap) < {ratio} then null else max(case when r = 1 then mid end) end as threshold from (
      select count(*) over () as n, gap, mid, row_number() over (order by gap desc nulls last, score) as r from (
      select score, case when score = 0 then 1e308 else nxt / score end as gap, round(case when score = 0 then nxt else sqrt(score * nxt) end, 2) as mid from (
      select score, lead(score) over (order by score) as nxt from ({_REUSE}) a) b) c) e"""


@operator("o")
def creation_counts(d):
    """For each activity and type: in how many events how many objects appear for the first time; pairs that never create are left out."""
    return f"""with f as (select eid, otype, count(*) as k from (select oid, otype, {d.earliest('eid', 'us', 'eid')} as eid from {{eo}} group by oid, otype) x group by eid, otype),
      p as (select distinct e.activity, f.otype from f join {{ev}} e on f.eid = e.eid),
      h as (select p.activity, p.otype, e.eid, coalesce(f.k, 0) as created from p join {{ev}} e on p.activity = e.activity left join f on f.eid = e.eid and f.otype = p.otype)
      select activity, otype, cast(created as bigint) as created, count(*) as n_events from h group by activity, otype, created"""


@operator("c")
def transition_global(d):
    """Bigram shares over all traces."""
    return """with b as (select activity as a, next_activity as b from {seq})
      select a, b, n, round(n * 1.0 / sum(n) over (partition by a), 6) as p from (select a, b, count(*) as n from b where b is not null group by a, b) x"""


@operator("u")
def transition_oc(d):
    """a to another activity b on an object's trace, as a share of all firings of a."""
    return f"""with b as (select activity as a, next_activity as b from {{seq}}), t as (select a, count(*) as total from b group by a)
      select b.a, b.b, count(*) as n, round(count(*) * 1.0 / max(t.total), 6) as p from b join t on b.a = t.a where b.b is not null and b.b <> b.a group by b.a, b.b"""


@operator("u")
def trace_end_prob(d):
    return f"select activity, round(avg(case when nxt is null then 1.0 else 0.0 end), 6) as p_end from (select activity, next_activity as nxt from {{seq}}) x group by activity"


@operator("u")
def start_end_counts(d):
    return f"""select activity, cast(sum(case when before is null then 1 else 0 end) as bigint) as n_start, cast(sum(case when nxt is null then 1 else 0 end) as bigint) as n_end
      from (select activity, prev_activity as before, next_activity as nxt from {{seq}}) x group by activity"""


@operator("u")
def trace_position(d):
    placed = sums_before(d, "(select oid, us, eid, activity, 1 as one from {eo})", "one", "activity")
    return f"""select x.activity, round(avg(case when t.n = 1 then 0.0 else x.b_one / (t.n - 1.0) end), 4) as position from {placed} x join (select oid, count(*) as n from {{eo}} group by oid) t on t.oid = x.oid group by x.activity"""


@operator("u")
def transition_by_type(d):
    return f"""select otype, prev, activity as next, n, round(n * 1.0 / sum(n) over (partition by otype, prev), 6) as p from
      (select otype, prev, activity, count(*) as n from (select otype, activity, coalesce(prev_activity, '<START>') as prev from {{seq}}) x group by otype, prev, activity) y"""


@operator("u", min_pct=1.0)
def start_activities(d, min_pct):
    return f"""select activity, n, pct from (select activity, n, round(100.0 * n / sum(n) over (), 1) as pct from
      (select activity, count(*) as n from (select {d.earliest('activity', 'us', 'eid')} as activity from {{eo}} group by oid) x group by activity) y) z where pct >= {min_pct}"""


@operator("o", share=0.95)
def strict_start(d, share):
    """Activities of whose firings at least a share has no strictly earlier event on any of its objects."""
    return f"""select activity, n, n_first from (select activity, count(*) as n, cast(sum(case when us <= earliest then 1 else 0 end) as bigint) as n_first from
      (select e.eid, e.activity, e.us, min(f.us) as earliest from {{eo}} e join (select oid, min(us) as us from {{eo}} group by oid) f on e.oid = f.oid group by e.eid, e.activity, e.us) x group by activity) y
      where n_first >= {share} * n"""


@operator("o")
def o2o_rules(d):
    """Declared links both ways between types: least and most partners of objects that have any; equal ends are one two-way rule."""
    return f"""with l as (select o.src, a.otype as st, o.dst, b.otype as dt, o.qualifier from {{o2o}} o join {{ob}} a on o.src = a.oid join {{ob}} b on o.dst = b.oid where a.otype <> b.otype),
      q as (select least(st, dt) as x, greatest(st, dt) as y, {d.join_distinct('qualifier', ',')} as qualifiers from l group by least(st, dt), greatest(st, dt)),
      n as (select st, dt, src, count(distinct dst) as k from (select st, dt, src, dst from l union all select dt, st, dst, src from l) u group by st, dt, src),
      r as (select st, dt, min(k) as lo, max(k) as hi from n group by st, dt)
      select r.st as source_type, r.dt as target_type, r.lo as min_links, r.hi as max_links, case when r.lo = z.lo and r.hi = z.hi then true else false end as two_way, q.qualifiers
      from r join r z on r.st = z.dt and r.dt = z.st join q on q.x = least(r.st, r.dt) and q.y = greatest(r.st, r.dt) where not (r.lo = z.lo and r.hi = z.hi and r.st > r.dt)"""


@operator("o")
def participation(d):
    return """with t as (select activity, count(*) as n from {ev} group by activity), p as (select activity, otype, count(distinct eid) as n_with, count(*) as links from {eo} group by activity, otype)
      select p.activity, p.otype, p.n_with as n_events, round(p.links * 1.0 / t.n, 6) as mean_objects from p join t on p.activity = t.activity"""


@operator("c")
def streaks(d):
    """Longest run of one activity on an object."""
    marked = "(select oid, us, eid, otype, activity, case when prev_activity = activity then 0 else 1 end as changed, case when prev_activity = activity then 0 else 1 end as own from {seq})"
    runs = sums_before(d, marked, "changed", "otype, activity, own")
    return f"""select otype, activity, max(n) as longest from (select otype, oid, activity, b_changed + own as grp, count(*) as n from {runs} y group by otype, oid, activity, b_changed + own) z group by otype, activity"""


def ngrams(d, n):
    """Runs of n activities with n - 1 marks before and after each trace."""
    cols = []
    for i in range(n):
        cols.append(f"lead(activity, {i}) over (partition by oid order by z, us, eid)" if i else "activity")
    pad = " union all ".join(f"select oid, otype, {z} as z, cast({k} as bigint) as us, '' as eid, '{m}' as activity from {{ob}}" for k in range(n - 1) for z, m in ((0, "<S>"), (2, "<E>")))
    grams = ", ".join(f"{c} as g{i}" for i, c in enumerate(cols))
    return f"""select otype, concat_ws('>', {', '.join(f'g{i}' for i in range(n))}) as gram, count(*) as n from (select otype, {grams} from
      (select oid, otype, 1 as z, us, eid, activity from {{eo}} union all {pad}) x) y where g{n - 1} is not null group by otype, concat_ws('>', {', '.join(f'g{i}' for i in range(n))})"""


add("ngrams_2", "c", ngrams, n=2)
add("ngrams_3", "c", ngrams, n=3)


@operator("u")
def object_gaps(d):
    return f"select otype, count(gap) as n, round(avg(gap), 6) as mean_s, round(max(gap), 6) as max_s from (select otype, (us - prev_us) / 1e6 as gap from {{seq}}) x group by otype"


@operator("u")
def inter_event_gaps(d):
    """Gaps between neighbours in time; the order is cut at hours, whose last events are joined to the next hour's first, so no task sees the whole log."""
    return """with h as (select cast(floor(us / 3600000000.0) as bigint) as hr, us, eid from {ev}),
      i as (select us - lag(us) over (partition by hr order by us, eid) as gap from h),
      e as (select hr, min(us) as a, max(us) as b from h group by hr),
      j as (select a - lag(b) over (order by hr) as gap from e)
      select count(*) as n, round(avg(gap) / 1e6, 6) as mean_s, round(max(gap) / 1e6, 6) as max_s from (select gap from i where gap is not null union all select gap from j where gap is not null) u"""


@operator("u")
def backward_sojourn(d):
    """Time since the latest earlier event on any of an event's objects."""
    return f"""select activity, count(gap) as n, round(avg(gap), 6) as mean_s from (select activity, eid, (us - max(prev)) / 1e6 as gap from (select activity, eid, us, prev_us as prev from {{seq}}) x group by activity, eid, us) y group by activity"""


@operator("u")
def dfg(d):
    return f"select a, b, count(*) as n from (select activity as a, next_activity as b from {{seq}}) x where b is not null group by a, b"


@operator("u", k=10)
def top_transitions(d, k):
    return f"select a, b, n from (select a, b, n, row_number() over (order by n desc, a, b) as r from (select a, b, count(*) as n from (select activity as a, next_activity as b from {{seq}}) x where b is not null group by a, b) y) z where r <= {k}"


@operator("u", k=10)
def last_events(d, k):
    return f"select eid, activity, us from {{ev}} order by us desc, eid desc limit {k}"


@operator("u", digits=4)
def normalize_rows(d, digits):
    return f"select a, b, round(n * 1.0 / sum(n) over (partition by a), {digits}) as p from (select a, b, count(*) as n from (select activity as a, next_activity as b from {{seq}}) x where b is not null group by a, b) y"


@operator("o")
def tied_events(d):
    return "select activity, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as n_tied, count(*) as n from (select e.activity, t.n from {ev} e join (select us, count(*) as n from {ev} group by us) t on e.us = t.us) x group by activity"


@operator("o")
def validate_orphans(d):
    """Faults that strict loading refuses: links to unknown objects or events, repeated ids, events without a time."""
    return """select 'unknown_object' as fault, count(*) as n from {e2o} x left join {ob} o on x.oid = o.oid where o.oid is null
      union all select 'unknown_event', count(*) from {e2o} x left join {ev} e on x.eid = e.eid where e.eid is null
      union all select 'repeated_event', count(*) from (select eid from {ev} group by eid having count(*) > 1) x
      union all select 'repeated_object', count(*) from (select oid from {ob} group by oid having count(*) > 1) x
      union all select 'missing_time', count(*) from {ev} where us is null"""


@operator("o")
def log_diagnostics(d):
    """Counts of what a strict reader of a log would want to know. Times are one zone's microseconds, so no mixed zones can occur here."""
    if d.name == "spark":  # events and their links meet once; of times that an object has once nothing is passed on
        return """with z as (select eid, oid, e, count(*) as n from (select /*+ repartition(eid) */ eid, oid, e from (select eid, oid, 0 as e from {e2o} union all select eid, cast(null as string), 1 from {ev}) u) v group by eid, oid, e),
          y as (select eid, sum(case when e = 1 then n else 0 end) as events, sum(case when e = 0 then 1 else 0 end) as links, sum(case when e = 0 then n - 1 else 0 end) as again from z group by eid),
          s as (select coalesce(sum(case when links = 0 or eid is null then events else 0 end), 0) as unattached, coalesce(sum(again), 0) as again from y)
          select 'events' as what, count(*) as n from {ev} union all select 'objects', count(*) from {ob}
          union all select k.what, case when k.what = 'unattached_events' then s.unattached else s.again end from s cross join (select explode(array('unattached_events', 'repeated_attachments')) as what) k
          union all select 'unused_objects', count(*) from {ob} o left join (select distinct oid from {e2o}) x on o.oid = x.oid where x.oid is null
          union all select 'tied_timelines', count(*) from (select distinct oid from (select oid, us from {eo} group by oid, us having count(*) > 1 or us is null) t) x"""
    return """select 'events' as what, count(*) as n from {ev} union all select 'objects', count(*) from {ob}
      union all select 'unattached_events', count(*) from {ev} e left join {e2o} x on e.eid = x.eid where x.eid is null
      union all select 'unused_objects', count(*) from {ob} o left join {e2o} x on o.oid = x.oid where x.oid is null
      union all select 'repeated_attachments', cast(coalesce(sum(n - 1), 0) as bigint) from (select eid, oid, count(*) as n from {e2o} group by eid, oid) x
      union all select 'tied_timelines', count(*) from (select oid from {eo} group by oid having count(*) > count(distinct us)) x"""


@operator("u", op=">", value="50", attr="us")
def guard_filter(d, op, value, attr):
    """Objects whose last event's time, activity or name passes a guard; both sides as numbers if both are, else as text; a missing value never passes."""
    if attr not in ("us", "activity", "eid"):
        raise ValueError(f"events have no {attr}")
    ops = {"==": "=", "!=": "<>", ">": ">", "<": "<", ">=": ">=", "<=": "<="}
    last = f"select oid, cast({d.latest(attr, 'us', 'eid')} as varchar(30)) as v from {{eo}} group by oid"
    if op not in ops:
        return f"select oid, v from ({last}) x where 1 = 0"
    c = ops[op]
    return f"""select oid, v from ({last}) x where v is not null and
      case when try_cast(v as double) is not null and try_cast('{value}' as double) is not null then try_cast(v as double) {c} try_cast('{value}' as double) else v {c} '{value}' end"""


@operator("u")
def cooccurrence_pairs(d):
    """Activities that meet on an object: by the activities' counts on it, without pairing its events."""
    return "select a.activity as a, b.activity as b, cast(sum(a.n * b.n) as bigint) as n_pairs, count(*) as n_objects from (select oid, activity, count(*) as n from {eo} group by oid, activity) a join (select oid, activity, count(*) as n from {eo} group by oid, activity) b on a.oid = b.oid group by a.activity, b.activity"


@operator("o")
def case_tracker(d):
    """Objects first seen at each activity, and how long after it their last event is."""
    return f"""with f as (select oid, otype, {d.earliest('activity', 'us', 'eid')} as activity, min(us) as us, max(us) as last_us from {{eo}} group by oid, otype)
      select activity, otype, count(*) as n, round(avg((last_us - us) / 1e6), 3) as mean_s, min((last_us - us) / 1e6) as min_s, max((last_us - us) / 1e6) as max_s from f group by activity, otype"""


@operator("u")
def tumbling_activity_counts(d):
    return "select activity, cast(floor(us / 3600000000.0) as bigint) as hour_no, count(*) as n from {ev} group by activity, cast(floor(us / 3600000000.0) as bigint)"


@operator("u", width_h=6)
def sliding_activity_counts(d, width_h):
    return f"select activity, cast(floor(us / 3600000000.0) as bigint) - k.n as first_hour, count(*) as n from {{ev}} cross join {d.numbers('0', str(width_h - 1))} k group by activity, cast(floor(us / 3600000000.0) as bigint) - k.n"


@operator("u", gap_s=86400)
def session_windows(d, gap_s):
    fresh = f"case when us - prev_us <= {gap_s * 1000000} then 0 else 1 end"
    rows = sums_before(d, f"(select oid, us, eid, otype, {fresh} as fresh, {fresh} as own from {{seq}})", "fresh", "otype, own")
    return f"""select otype, count(*) as n_sessions, max(n) as longest from (select otype, oid, b_fresh + own as grp, count(*) as n from {rows} y group by otype, oid, b_fresh + own) z group by otype"""
