"""Checking declarative arcs between activities, with each / all / any scopes over object types.

An arc (AS, EF, EP, DF, DP) counts target events for each binding of an activation. AS
takes all of them, EF and EP those strictly later or earlier, DF and DP those among the
nearest strictly later or earlier events of the scope, ties together, whatever their
activity. A binding holds one object of every Each type; its events must share all of the
binding's objects, all objects of All types, and one of every Any type. An arc without
types has one binding for each activation, whose scope is the whole log.

Each labels alone are counted with windows over the days of an object, or of a tuple of objects of
all labels, whose totals are carried on, without a self-join, so no task sorts a whole timeline.
With All and Any labels bindings and events are joined by the binding's rarest object.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..log import EventLog
from ..plans import cuts
from ..plans.dialect import SPARK
from ..registry import add, doubles, operator

@dataclass(frozen=True)
class Arc:
    src: str
    tgt: str
    arc: str = "EF"
    each: tuple[str, ...] = ()
    all_: tuple[str, ...] = ()
    any_: tuple[str, ...] = ()
    nmin: int = 1
    nmax: int | None = None

    def __post_init__(self) -> None:
        if self.arc not in ("AS", "EF", "EP", "DF", "DP"):
            raise ValueError(f"unknown arc {self.arc}")
        if any(c in t for t in (*self.each, *self.all_, *self.any_) for c in "<>"):
            raise NotImplementedError("indirect labels")


def _q(x: str) -> str:
    return "'" + x.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def assignments(types: tuple[str, ...]) -> str:
    """oid, us, eid, activity: events under each assignment of one of their objects of each type."""
    if len(types) == 1:
        return f"(select oid, eid, activity, us from {{eo}} where otype = {_q(types[0])})"
    joins = " ".join(f"join {{e2o}} y{i} on y{i}.eid = v.eid and y{i}.otype = {_q(t)}" for i, t in enumerate(types))
    return f"(select concat_ws(chr(31), {', '.join(f'y{i}.oid' for i in range(len(types)))}) as oid, v.us, v.eid, v.activity from {{ev}} v {joins})"


def _assigned(types: tuple[str, ...], activities: tuple[str, ...] = ()) -> tuple[str, str]:
    """assignments() of activities (all, if none is named) in Spark, with base, the object of the first type; and rows of base alone, by which long ones are told."""
    of = f" and v.activity in ({', '.join(map(_q, activities))})" if activities else ""
    joins = " ".join(f"join {{e2o}} y{i} on y{i}.eid = v.eid and y{i}.otype = {_q(t)}" for i, t in enumerate(types) if i)
    oid = f"concat_ws(chr(31), v.oid{''.join(f', y{i}.oid' for i in range(1, len(types)))})" if len(types) > 1 else "v.oid"
    return f"(select {oid} as oid, v.oid as base, v.us, v.eid, v.activity from {{eo}} v {joins} where v.otype = {_q(types[0])}{of})", f"(select v.oid as base from {{eo}} v where v.otype = {_q(types[0])}{of})"


def _single_lean(a: Arc) -> str:
    """_single() in Spark: of AS, EF and EP arcs only sources and targets are shuffled, targets without their names."""
    if a.arc == "AS":
        n = f"select oid, count(*) as n from {_assigned(a.each, (a.tgt,))[0]} t group by oid"
        return f"select x.eid, x.oid as bid, cast(coalesce(y.n, 0) as bigint) as n from {_assigned(a.each, (a.src,))[0]} x left join ({n}) y on y.oid = x.oid"
    rows, sizes = _assigned(a.each, (a.src, a.tgt))
    named = f"(select oid, base, us, case when activity = {_q(a.tgt)} then 1 else 0 end as hit, activity = {_q(a.src)} as mine, case when activity = {_q(a.src)} then eid end as eid from {rows} q)"
    return f"select eid, oid as bid, cast(n as bigint) as n from {cuts.beyond_('oid', named, sizes, a.arc == 'EF', 'eid, mine')} t where mine"


def _single(a: Arc, d=SPARK) -> str:
    """eid, bid, n of Each labels alone, by windows over the days of each assignment of objects."""
    if d.name == "spark" and a.arc in ("AS", "EF", "EP"):
        return _single_lean(a)
    hit = f"case when activity = {_q(a.tgt)} then 1 else 0 end"
    rows = assignments(a.each)
    mine = f"activity = {_q(a.src)}"
    if a.arc == "AS":
        return f"select x.eid, x.oid as bid, cast(coalesce(y.n, 0) as bigint) as n from {rows} x left join (select oid, sum({hit}) as n from {rows} t group by oid) y on y.oid = x.oid where x.{mine}"
    if a.arc in ("EF", "EP"):
        return f"select eid, oid as bid, cast(n as bigint) as n from {cuts.beyond('oid', rows, hit, a.arc == 'EF', 'eid, activity')} t where {mine}"
    at = f"select oid, us, sum({hit}) as n from {rows} t group by oid, us"
    return f"select x.eid, x.oid as bid, cast(coalesce(y.n, 0) as bigint) as n from {cuts.nearest('oid', rows, a.arc == 'DF', 'eid, activity')} x left join ({at}) y on x.oid = y.oid and x.near_us = y.us where x.{mine}"


def _whole(a: Arc) -> str:
    """eid, bid, n of an arc without types. The log's times, one row each, are ordered within minutes, which carry totals on."""
    mine = f"activity = {_q(a.src)}"
    hit = f"activity = {_q(a.tgt)}"
    if a.arc == "AS":
        return f"select eid, eid as bid, (select count(*) from {{ev}} where {hit}) as n from {{ev}} where {mine}"
    times = f"(select 1 as k, us, sum(case when {hit} then 1 else 0 end) as hits from {{ev}} group by us)"
    ahead = a.arc in ("EF", "DF")
    if a.arc in ("EF", "EP"):
        return f"select x.eid, x.eid as bid, cast(y.n as bigint) as n from {{ev}} x join {cuts.beyond('k', times, 'hits', ahead, 'hits', cuts.MINUTE)} y on y.us = x.us where x.{mine}"
    return f"""select x.eid, x.eid as bid, cast(coalesce(z.hits, 0) as bigint) as n from {{ev}} x join {cuts.nearest('k', times, ahead, 'hits', cuts.MINUTE)} y on y.us = x.us
      left join {times} z on z.us = y.near_us where x.{mine}"""


def _loose_lean(a: Arc) -> str:
    """bindings_sql() in Spark of All and Any labels without Each, where an activation is its own binding.

    The activations' objects come from {eo} without a join. A binding with one required object needs
    no look whether the others are there. Candidates are dealt by binding once; of an Any type the
    candidates' objects are looked up before the bindings', which are more often many.
    """
    timed = {"AS": "1 = 1", "EF": "f.us > w.t", "DF": "f.us > w.t", "EP": "f.us < w.t", "DP": "f.us < w.t"}[a.arc]
    direct = a.arc in ("DF", "DP")
    tgt = "" if direct else f" and f.activity = {_q(a.tgt)}"
    own = lambda types: f"from {{eo}} v where v.activity = {_q(a.src)} and v.otype in ({', '.join(map(_q, types))})"
    parts = [f"b as (select eid, eid as bid from {{ev}} where activity = {_q(a.src)})"]
    if a.all_:
        kinds = ", ".join(map(_q, a.all_))
        parts += [
            f"req as (select v.eid as bid, v.us as t, v.oid {own(a.all_)})",
            "need as (select bid, count(*) as k, min(t) as t, min(oid) as oid from req group by bid)",
            "several as (select r.bid, r.t, r.oid, n.k from req r join need n on n.bid = r.bid where n.k > 1)",
            f"size as (select x.oid, count(*) as events from {{e2o}} x join (select distinct oid from several) r on x.oid = r.oid where x.otype in ({kinds}) group by x.oid)",
            "walk as (select bid, t, oid, k from need where k = 1 union all select bid, t, oid, k from (select r.*, row_number() over (partition by r.bid order by s.events, r.oid) as rk from several r join size s on s.oid = r.oid) x where rk = 1)",
            f"seen as (select /*+ repartition(bid) */ w.bid, f.eid, f.us, w.k from walk w join {{eo}} f on f.oid = w.oid where f.otype in ({kinds}) and {timed}{tgt})",
            f"""cand as (select bid, eid, us from seen where k = 1 group by bid, eid, us having count(*) = 1
              union all select s.bid, s.eid, s.us from seen s join several r on r.bid = s.bid join {{e2o}} y on y.eid = s.eid and y.oid = r.oid where s.k > 1 and y.otype in ({kinds}) group by s.bid, s.eid, s.us, s.k having count(*) = s.k)""",
        ]
        left = a.any_
    else:
        first, left = a.any_[0], a.any_[1:]
        parts.append(f"cand as (select distinct bid, eid, us from (select /*+ repartition(bid) */ w.bid, f.eid, f.us from (select v.eid as bid, v.us as t, v.oid {own((first,))}) w join {{eo}} f on f.oid = w.oid where f.otype = {_q(first)} and {timed}{tgt}) z)")
    met = "cand"
    for i, t in enumerate(left):
        theirs = f"(select f.eid, f.oid from {{eo}} f where f.otype = {_q(t)}{tgt})"
        parts.append(f"any{i} as (select distinct c.bid, c.eid, c.us from {met} c join {theirs} y on y.eid = c.eid join (select v.eid as bid, v.oid {own((t,))}) x on x.bid = c.bid and x.oid = y.oid)")
        met = f"any{i}"
    if direct:
        parts.append(f"near as (select bid, eid from (select bid, eid, rank() over (partition by bid order by us {'desc' if a.arc == 'DP' else 'asc'}) as r from {met}) x where r = 1)")
        hits = f"select m.bid, count(*) as n from near m join {{ev}} f on f.eid = m.eid where f.activity = {_q(a.tgt)} group by m.bid"
    else:
        hits = f"select bid, count(*) as n from {met} group by bid"
    return f"with {', '.join(parts)} select b.eid, b.bid, coalesce(h.n, 0) as n from b left join ({hits}) h on h.bid = b.bid"


def bindings_sql(a: Arc, d=SPARK) -> str:
    """SQL for eid, bid, n: how many target events each binding of each activation has."""
    if not (a.each or a.all_ or a.any_):
        return _whole(a)
    if a.each and not a.all_ and not a.any_:
        return _single(a, d)
    if d.name == "spark" and not a.each:
        return _loose_lean(a)
    cols = [f"o{i}" for i in range(len(a.each))]
    joins = " ".join(f"join {{e2o}} e{i} on e{i}.eid = a.eid and e{i}.otype = {_q(t)}" for i, t in enumerate(a.each))
    bid = "concat_ws('|', a.eid" + "".join(f", e{i}.oid" for i in range(len(a.each))) + ")"
    b = f"select a.eid, a.us as t, {bid} as bid" + "".join(f", e{i}.oid as {c}" for i, c in enumerate(cols)) + f" from {{ev}} a {joins} where a.activity = {_q(a.src)}"
    req = [f"select bid, {c} as oid from b" for c in cols]
    if a.all_:
        req.append(f"select b.bid, x.oid from b join {{e2o}} x on x.eid = b.eid and x.otype in ({', '.join(map(_q, a.all_))})")
    timed = {"AS": "1 = 1", "EF": "f.us > b.t", "DF": "f.us > b.t", "EP": "f.us < b.t", "DP": "f.us < b.t"}[a.arc]
    direct = a.arc in ("DF", "DP")
    # commuting arcs meet target events only; direct arcs need the nearest event of any activity first
    wanted = "" if direct else f" and f.activity = {_q(a.tgt)}"
    parts = [f"b as ({b})"]
    if cols and not a.all_:
        # of a binding's objects the one with the fewest events is walked; the others are looked up by (event, object)
        sizes = " ".join(f"join size s{i} on s{i}.oid = b.{c}" for i, c in enumerate(cols))
        walk = " ".join(f"when {' and '.join(f's{i}.events <= s{j}.events' for j in range(len(cols)) if j != i) or '1 = 1'} then b.{c}" for i, c in enumerate(cols))
        there = " ".join(f"join {{e2o}} y{i} on y{i}.eid = f.eid and y{i}.oid = b.{c}" for i, c in enumerate(cols))
        parts += [
            "size as (select oid, count(*) as events from {e2o} group by oid)",
            f"walk as (select b.*, case {walk} end as oid from b {sizes})",
            f"cand as (select b.bid, f.eid, f.us from walk b join {{eo}} f on f.oid = b.oid {there} where {timed}{wanted})",
        ]
        left = a.any_
    elif req:
        # the same where the number of objects isn't known before: of a binding's objects the one with the fewest events is walked; that the others are there is looked up by (event, object)
        parts += [
            f"req as ({' union '.join(req)})",
            "need as (select bid, count(*) as k from req group by bid)",
            "size as (select x.oid, count(*) as events from {e2o} x join (select distinct oid from req) r on x.oid = r.oid group by x.oid)",
            "walk as (select bid, oid from (select r.bid, r.oid, row_number() over (partition by r.bid order by s.events, r.oid) as rk from req r join size s on s.oid = r.oid) x where rk = 1)",
            f"seen as (select w.bid, f.eid, f.us from walk w join b on b.bid = w.bid join {{eo}} f on f.oid = w.oid where {timed}{wanted})",
            """cand as (select s.bid, s.eid, s.us from seen s join need n on n.bid = s.bid join req r on r.bid = s.bid join {e2o} y on y.eid = s.eid and y.oid = r.oid
              group by s.bid, s.eid, s.us, n.k having count(*) = n.k)""",
        ]
        left = a.any_
    else:
        first, left = a.any_[0], a.any_[1:]
        parts.append(f"cand as (select distinct b.bid, f.eid, f.us from b join {{e2o}} x on x.eid = b.eid and x.otype = {_q(first)} join {{eo}} f on f.oid = x.oid where {timed}{wanted})")
    for i, t in enumerate(left):
        # from the candidates on: an object's other events are never looked at
        parts.append(f"any{i} as (select distinct c.bid, c.eid from cand c join b on b.bid = c.bid join {{e2o}} x on x.eid = b.eid and x.otype = {_q(t)} join {{e2o}} y on y.eid = c.eid and y.oid = x.oid)")
    semi = " ".join(f"join any{i} on any{i}.bid = c.bid and any{i}.eid = c.eid" for i in range(len(left)))
    parts.append(f"met as (select c.bid, c.eid, c.us from cand c {semi})")
    if direct:
        parts.append(f"near as (select bid, eid from (select bid, eid, rank() over (partition by bid order by us {'desc' if a.arc == 'DP' else 'asc'}) as r from met) x where r = 1)")
        hits = f"select m.bid, count(*) as n from near m join {{ev}} f on f.eid = m.eid where f.activity = {_q(a.tgt)} group by m.bid"
    else:
        hits = "select bid, count(*) as n from met group by bid"
    return f"with {', '.join(parts)} select b.eid, b.bid, coalesce(h.n, 0) as n from b left join ({hits}) h on h.bid = b.bid"


def bindings(log: EventLog, arc: Arc) -> DataFrame:
    return log.sql(doubles(bindings_sql(arc)))


def _ok(a: Arc, n: str = "n") -> str:
    return f"{n} >= {a.nmin}" + ("" if a.nmax is None else f" and {n} <= {a.nmax}")


def activations_sql(a: Arc, d=SPARK) -> str:
    """eid, lo, hi, ok of activations that have a binding."""
    return f"select eid, min(n) as lo, max(n) as hi, min(case when {_ok(a)} then 1 else 0 end) as ok from ({bindings_sql(a, d)}) w group by eid"


def support_sql(d, a: Arc) -> str:
    """Share of activations with an object of every label that satisfy the arc (the miner's denominator)."""
    have = f"select eid from {{ev}} where activity = {_q(a.src)}"
    for t in (*a.each, *a.all_, *a.any_):
        have = f"select h.eid from ({have}) h join (select distinct eid from {{e2o}} where otype = {_q(t)}) t on h.eid = t.eid"
    return f"""select count(*) as total, cast(coalesce(sum(x.ok), 0) as bigint) as satisfied, round(coalesce(sum(x.ok), 0) * 1.0 / nullif(count(*), 0), 4) as support,
      min(x.lo) as observed_min, max(x.hi) as observed_max from ({have}) h join ({activations_sql(a, d)}) x on h.eid = x.eid"""


def support(log: EventLog, arc: Arc) -> DataFrame:
    return log.sql(doubles(support_sql(SPARK, arc)))


def confidence_sql(d, arcs: list[Arc]) -> str:
    """A row for each arc: activations, violated, vacuous, confidence over all activations, observed bounds."""
    rows = []
    for i, a in enumerate(arcs):
        rows.append(f"""select {i} as cid, {_q(a.arc)} as arc, {_q(a.src)} as src, {_q(a.tgt)} as tgt, count(*) as activations,
          cast(coalesce(sum(case when x.ok = 0 then 1 else 0 end), 0) as bigint) as violated, cast(coalesce(sum(case when x.ok is null then 1 else 0 end), 0) as bigint) as vacuous,
          round(1.0 - sum(case when x.ok = 0 then 1 else 0 end) * 1.0 / nullif(count(*), 0), 6) as confidence, min(x.lo) as observed_min, max(x.hi) as observed_max
          from (select eid from {{ev}} where activity = {_q(a.src)}) e left join ({activations_sql(a, d)}) x on e.eid = x.eid""")
    return " union all ".join(rows)


def violations_sql(d, arcs: list[Arc]) -> str:
    return " union all ".join(f"select {i} as cid, eid, lo, hi from ({activations_sql(a, d)}) v where ok = 0" for i, a in enumerate(arcs))


def violation_report_sql(d, arcs: list[Arc]) -> str:
    """A row for each failed activation: its arc and bounds, time, how many bindings were evaluated and failed, least and greatest count."""
    rows = []
    for i, a in enumerate(arcs):
        nmax = "cast(null as bigint)" if a.nmax is None else f"cast({a.nmax} as bigint)"
        rows.append(f"""select {i} as constraint_id, {_q(a.arc)} as arc, {_q(a.src)} as activation_activity, {_q(a.tgt)} as counted_activity, e.eid, e.us, {a.nmin} as nmin, {nmax} as nmax,
          v.evaluated as n_evaluated_bindings, v.failed as n_failed_bindings, v.lo as minimum_observed_count, v.hi as maximum_observed_count
          from {{ev}} e join (select eid, count(*) as evaluated, cast(sum(case when {_ok(a)} then 0 else 1 end) as bigint) as failed, min(n) as lo, max(n) as hi from ({bindings_sql(a, d)}) w group by eid) v on v.eid = e.eid where v.failed > 0""")
    return " union all ".join(rows)


def violation_totals_sql(d, arcs: list[Arc]) -> str:
    """One row on all arcs: activations, violations, vacuous ones, rates, affected arcs and events; and whether the incidents agree with the confidence table and the global confidence."""
    return f"""with c as ({confidence_sql(d, arcs)}), i as ({violation_report_sql(d, arcs)}), g as ({global_confidence_sql(d, arcs)}),
      s as (select count(*) as n_constraints, cast(sum(case when activations = 0 then 1 else 0 end) as bigint) as n_inactive_constraints, cast(sum(activations) as bigint) as n_activations, cast(sum(violated) as bigint) as n_violating_activations,
        cast(sum(vacuous) as bigint) as n_vacuous_activations, cast(sum(case when violated > 0 then 1 else 0 end) as bigint) as n_constraints_affected from c),
      t as (select count(*) as incidents, count(distinct eid) as n_events_affected from i)
      select g.events as n_events, s.*, round(s.n_violating_activations * 1.0 / nullif(s.n_activations, 0), 6) as activation_violation_rate, t.n_events_affected, round(t.n_events_affected * 1.0 / nullif(g.events, 0), 6) as event_violation_rate,
        t.incidents = s.n_violating_activations as incidents_agree, t.n_events_affected = g.violating_events as events_agree from s cross join t cross join g"""


def violation_report(log: EventLog, arcs: list[Arc]) -> tuple[DataFrame, DataFrame]:
    """Incidents and the row of totals; an error if the incidents differ from the evaluators'."""
    totals = log.sql(doubles(violation_totals_sql(SPARK, arcs)))
    row = totals.first()
    if not (row.incidents_agree and row.events_agree):
        raise RuntimeError("incidents differ from the confidence evaluators")
    return log.sql(doubles(violation_report_sql(SPARK, arcs))), totals


def global_confidence_sql(d, arcs: list[Arc]) -> str:
    return f"""select round(1.0 - v.n * 1.0 / nullif(e.n, 0), 6) as global_confidence, v.n as violating_events, e.n as events
      from (select count(distinct eid) as n from ({violations_sql(d, arcs)}) q) v cross join (select count(*) as n from {{ev}}) e"""


def violation_summary_sql(d, arcs: list[Arc]) -> str:
    return f"select c.cid, c.activations, coalesce(v.n, 0) as incidents, round(coalesce(v.n, 0) * 1.0 / nullif(c.activations, 0), 6) as rate from ({confidence_sql(d, arcs)}) c left join (select cid, count(*) as n from ({violations_sql(d, arcs)}) q group by cid) v on v.cid = c.cid"


def confidence_report_sql(d, arcs: list[Arc]) -> str:
    """A row for each arc with its labels and bounds: activations, satisfied, violating, vacuous, confidence (null without activations), mean count of a binding."""
    rows = []
    for i, a in enumerate(arcs):
        names = ", ".join(f"{_q(', '.join(ts))} as {c}" for c, ts in (("each_types", a.each), ("all_types", a.all_), ("any_types", a.any_)))
        rows.append(f"""select {i} as constraint_id, {_q(a.arc)} as arc, {_q(a.src)} as activates_on, {_q(a.tgt)} as counts_activity, {names}, {a.nmin} as nmin, {'cast(null as int)' if a.nmax is None else a.nmax} as nmax,
          e.n as n_activations, e.n - x.bad as n_satisfied, x.bad as n_violating, e.n - x.held as n_vacuous_activations, round((e.n - x.bad) * 1.0 / nullif(e.n, 0), 6) as confidence, round(x.total * 1.0 / nullif(x.bindings, 0), 6) as mean_binding_count
          from (select count(*) as n from {{ev}} where activity = {_q(a.src)}) e cross join (select cast(coalesce(sum(1 - ok), 0) as bigint) as bad, count(*) as held, sum(total) as total, sum(bindings) as bindings
          from (select eid, min(case when {_ok(a)} then 1 else 0 end) as ok, sum(n) as total, count(*) as bindings from ({bindings_sql(a, d)}) w group by eid) v) x""")
    return " union all ".join(rows)


def coverage_details_sql(d, arcs: list[Arc]) -> str:
    """Of each arc: activations, those with a binding, share of those with an object of every label, of its finite bounds that are seen, whether a target is."""
    rows = []
    for i, a in enumerate(arcs):
        have = f"select eid from {{ev}} where activity = {_q(a.src)}"
        for t in (*a.each, *a.all_, *a.any_):
            have = f"select h.eid from ({have}) h join (select distinct eid from {{e2o}} where otype = {_q(t)}) t on h.eid = t.eid"
        bounds = sorted({a.nmin} | ({a.nmax} if a.nmax is not None else set()))
        seen = " + ".join(f"max(case when n = {x} then 1 else 0 end)" for x in bounds)
        rows.append(f"""select {i} as cid, e.n as activations, x.held as with_binding, round(p.n * 1.0 / nullif(e.n, 0), 6) as object_presence, round(x.seen * 1.0 / {len(bounds)}, 6) as finite_boundary,
          {'coalesce(x.hit, 0) * 1.0' if a.nmin > 0 else 'cast(null as double)'} as matching_event
          from (select count(*) as n from {{ev}} where activity = {_q(a.src)}) e cross join (select count(*) as n from ({have}) g) p
          cross join (select count(distinct eid) as held, {seen} as seen, max(case when n > 0 then 1 else 0 end) as hit from ({bindings_sql(a, d)}) w) x""")
    return " union all ".join(rows)


def coverage_sql(d, arcs: list[Arc]) -> str:
    """Seven scores of a model: its activities and types in the log; arcs with activations, with bindings; means of the details, nulls left out."""
    acts = sorted({x for a in arcs for x in (a.src, a.tgt)})
    types = sorted({t for a in arcs for t in (*a.each, *a.all_, *a.any_)})
    inside = lambda xs: ", ".join(map(_q, xs))
    own = [("source_activation", "avg(case when activations > 0 then 1.0 else 0.0 end)"), ("non_vacuous", "avg(case when with_binding > 0 then 1.0 else 0.0 end)")]
    own += [(c, f"avg({c})") for c in ("object_presence", "finite_boundary", "matching_event")]
    scores = ", ".join(f"{v} as {c}" for c, v in own)
    each = " ".join(f"when k.n = {i} then '{c}'" for i, (c, _) in enumerate(own))
    value = " ".join(f"when k.n = {i} then s.{c}" for i, (c, _) in enumerate(own))
    return f"""select 'activity' as score, round(count(distinct activity) * 1.0 / {len(acts)}, 6) as value from {{ev}} where activity in ({inside(acts)})
      union all select 'object_type', {f"round(count(distinct otype) * 1.0 / {len(types)}, 6) from {{ob}} where otype in ({inside(types)})" if types else "cast(null as double)"}
      union all select case {each} end, round(case {value} end, 6) from (select {scores} from ({coverage_details_sql(d, arcs)}) c) s cross join {d.numbers('0', str(len(own) - 1))} k"""


def apply_bounds(arcs: list[Arc], observed: list[tuple[int | None, int | None]]) -> list[Arc]:
    """Arcs with the observed bounds written in; an arc without evidence keeps its own."""
    if len(arcs) != len(observed):
        raise ValueError("a report must have one row for each arc")
    from dataclasses import replace

    return [a if lo is None and hi is None else replace(a, nmin=a.nmin if lo is None else lo, nmax=hi) for a, (lo, hi) in zip(arcs, observed, strict=True)]


#: The model of the registered queries.
MODEL = [
    Arc("signup", "purchase", "EF", each=("user",)),
    Arc("purchase", "view", "EP", each=("user",)),
    Arc("view", "click", "DF", each=("user",)),
    Arc("click", "view", "DP", each=("item",)),
    Arc("error", "click", "AS", each=("user",), nmin=5, nmax=40),
]
ORDER_MODEL = [
    Arc("Place Order", "Ship Line", "EF", each=("order",)),
    Arc("Close Order", "Ship Line", "EP", each=("order",), all_=()),
    Arc("Close Order", "Ship Line", "AS", each=("order", "part")),
    Arc("Close Order", "Ship Line", "AS", all_=("order",), any_=("supplier",)),
]


def _support(a: Arc):
    return lambda d: support_sql(d, a)


def _of(f, arcs):
    return lambda d: f(d, arcs)


for _t in ("AS", "EF", "EP", "DF", "DP"):
    add(f"arc_{_t.lower()}", "u", _support(Arc("purchase", "view", _t, each=("user",))))
add("arc_order_each", "o", _support(ORDER_MODEL[0]))
add("arc_any", "o", _support(Arc("Close Order", "Ship Line", "AS", any_=("order",))))
add("arc_all", "o", _support(Arc("Close Order", "Ship Line", "EP", all_=("order",))))
add("arc_multi", "o", _support(ORDER_MODEL[2]))
add("arc_mixed", "o", _support(ORDER_MODEL[3]))
add("arc_direct_any", "o", _support(Arc("Place Order", "Ship Line", "DF", any_=("order",))))
add("arc_each_each", "u", _support(Arc("purchase", "view", "EF", each=("user", "item"))))
for _k, _f in (("confidence_table", confidence_sql), ("violation_incidents", violations_sql), ("global_confidence", global_confidence_sql), ("violation_summary", violation_summary_sql), ("coverage_scores", coverage_sql), ("coverage_details", coverage_details_sql), ("confidence_report", confidence_report_sql)):
    add(_k, "u", _of(_f, MODEL))
add("order_confidence_table", "o", _of(confidence_sql, ORDER_MODEL))
add("observed_bounds", "o", lambda d: f"select cid, observed_min, observed_max from ({confidence_sql(d, ORDER_MODEL)}) c")
add("apply_bounds", "u", lambda d: f"select c.cid, coalesce(c.observed_min, m.nmin) as nmin, case when c.observed_min is null and c.observed_max is null then m.nmax else c.observed_max end as nmax from ({confidence_sql(d, MODEL)}) c join ({' union all '.join(f'select {i} as cid, {a.nmin} as nmin, cast({a.nmax if a.nmax is not None else chr(110) + chr(117) + chr(108) + chr(108)} as bigint) as nmax' for i, a in enumerate(MODEL))}) m on m.cid = c.cid")


@operator("u", "trace_templates", src="view", tgt="purchase", otype="user", nmin=1, nmax=10)
def trace_templates(d, src, tgt, otype, nmin, nmax):
    """Fitness of whole traces to each template: how many were checked and how many broke it."""
    s, t = _q(src), _q(tgt)
    placed = "(select otype, oid, activity, row_number() over (partition by oid order by us, eid) as pos from {eo})" if d.name == "duck" else f"(select otype, oid, activity, b_one + 1 as pos from {cuts.before('oid', '(select oid, us, eid, otype, activity, 1 as one from {eo})', 'one', rest='otype, activity')} b)"
    f = f"""select oid, sum(case when activity = {s} then 1 else 0 end) as ns, sum(case when activity = {t} then 1 else 0 end) as nt,
      min(case when activity = {s} then pos end) as s1, max(case when activity = {t} then pos end) as t9, min(case when activity = {t} then pos end) as t1 from {placed} q where otype = {_q(otype)} group by oid"""
    rules = {
        "response": ("ns > 0", "t9 is null or t9 < s1"),
        "responded_existence": ("ns > 0", "nt = 0"),
        "precedence": ("nt > 0", "s1 is null or s1 > t1"),
        "not_coexistence": ("1 = 1", "ns > 0 and nt > 0"),
        "not_succession": ("ns > 0", "nt > 0"),
        "coexistence": ("ns > 0 or nt > 0", "ns = 0 or nt = 0"),
        "exclusive_choice": ("1 = 1", "(ns > 0) = (nt > 0)"),
        "existence": ("1 = 1", "ns = 0"),
        "absence": ("1 = 1", f"ns > {nmax}"),
        "exactly": ("1 = 1", f"ns <> {nmin}"),
        "chain_response": ("ns > 0", "1 = 0"),
    }
    case = " union all ".join(
        f"select '{k}' as template, cast(sum(case when {c} then 1 else 0 end) as bigint) as checked, cast(sum(case when ({c}) and ({v}) then 1 else 0 end) as bigint) as violated from f" for k, (c, v) in rules.items()
    )
    return f"with f as ({f}) select template, checked, violated, round(1.0 - violated * 1.0 / nullif(checked, 0), 4) as fitness from ({case}) r"


def prefix_rules(src: str, tgt: str, nmin: int, nmax: int) -> dict[str, str]:
    """When a monitor of each template refuses an event, of columns activity, prev, b_ns and b_nt (source and target events before)."""
    s, t = f"activity = {_q(src)}", f"activity = {_q(tgt)}"
    rules = {
        "precedence": f"{t} and b_ns < {nmin}",
        "response_cap": f"{t} and b_nt >= {nmax}",
        "chain_precedence": f"{t} and coalesce(prev, '') <> {_q(src)}",
        "chain_response": f"prev = {_q(src)} and not ({t})",
        "not_coexistence": f"({t} and b_ns > 0) or ({s} and b_nt > 0)",
        "not_succession": f"{t} and b_ns > 0",
        "not_precedence": f"{t} and b_ns > 0",
        "not_chain_succession": f"{t} and prev = {_q(src)}",
        "absence": f"{s} and b_ns >= {nmax}",
        "exactly": f"{s} and b_ns >= {nmin}",
        "init": f"not ({t}) and b_nt = 0",
        "exclusive_choice": f"({s} and b_nt > 0) or ({t} and b_ns > 0)",
        "alternate_response": f"{s} and b_ns > b_nt",
        "alternate_precedence": f"{t} and b_nt >= b_ns",
    }
    for whole, parts in {"succession": ("precedence", "response_cap"), "chain_succession": ("chain_precedence", "chain_response"), "alternate_succession": ("alternate_response", "alternate_precedence")}.items():
        rules[whole] = " or ".join(f"({rules[p]})" for p in parts)
    return rules


#: Templates that count events of all labels' objects together; the others hold if they hold for each label alone.
JOINT = ("precedence", "response_cap", "chain_precedence", "chain_response", "chain_succession")


def _prefixes_lean(rows: str, sizes: str, src: str, tgt: str) -> str:
    """_prefixes() in Spark of rows with base and their sizes."""
    counted = f"(select oid, base, us, eid, activity, case when activity = {_q(src)} then 1 else 0 end as ns, case when activity = {_q(tgt)} then 1 else 0 end as nt from {rows} q)"
    return cuts.before_("oid", counted, sizes, "ns", "nt", rest="activity", last="activity")


def _prefixes(source: str, src: str, tgt: str, rest: str) -> str:
    """source (oid, us, eid, activity, rest) with b_ns, b_nt and prev."""
    rows = f"(select oid, us, eid, activity, case when activity = {_q(src)} then 1 else 0 end as ns, case when activity = {_q(tgt)} then 1 else 0 end as nt{rest and ', ' + rest} from {source} q)"
    return cuts.before("oid", rows, "ns", "nt", rest="activity" + (rest and ", " + rest), last="activity")


@operator("u", "prefix_templates", src="view", tgt="purchase", otype="user", nmin=1, nmax=10)
def prefix_templates(d, src, tgt, otype, nmin, nmax):
    """How many events an eager monitor of each template would refuse, looking only at what came before on the object."""
    f = f"select * from {_prefixes(f'(select * from {{eo}} where otype = {_q(otype)})', src, tgt, '')} b"
    rules = prefix_rules(src, tgt, nmin, nmax)
    return f"with f as ({f}) " + " union all ".join(f"select '{k}' as template, cast(sum(case when {r} then 1 else 0 end) as bigint) as refused, count(*) as events from f" for k, r in rules.items())


@operator("o", "prefix_joint", src="Place Order", tgt="Ship Line", types=("order", "supplier"), nmin=1, nmax=3)
def prefix_joint(d, src, tgt, types, nmin, nmax):
    """How many events each template refuses with several Each labels.

    A template of JOINT refuses an event if it does for one assignment of objects, by the events
    before that have all of the assignment; the others if they do for an object of any one type.
    Events count that have an object of each type (JOINT), or of some type.
    """
    rules = prefix_rules(src, tgt, nmin, nmax)
    out = []
    for names, source, part in ((JOINT, assignments(types), ""), ([k for k in rules if k not in JOINT], f"(select oid, us, eid, activity from {{eo}} where otype in ({', '.join(map(_q, types))}))", "")):
        flags = ", ".join(f"max(case when {rules[k]} then 1 else 0 end) as {k}" for k in names)
        rows = _prefixes(source, src, tgt, part)
        if d.name == "spark":
            any_type = f"(select oid, oid as base, us, eid, activity from {{eo}} where otype in ({', '.join(map(_q, types))}))"
            rows = _prefixes_lean(*(_assigned(types) if names is JOINT else (any_type, any_type)), src, tgt)
        each = f"select eid, {flags} from {rows} b group by eid"
        sums = ", ".join(f"cast(coalesce(sum({k}), 0) as bigint) as {k}" for k in names)
        out += [f"select {d.pick(names)} as template, {d.pick(names, quoted=False)} as refused, events from (select count(*) as events, {sums} from ({each}) e) s cross join {d.numbers('0', str(len(names) - 1))} k"]
    return " union all ".join(out)
