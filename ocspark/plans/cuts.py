"""SQL for windows over one long order, cut into ranges so that no task sorts a whole key.

Each helper orders rows within (key, range) and carries the ranges' totals on: the second
order is over one row a range, whatever the number of rows. All texts run on both engines.
"""

from __future__ import annotations

HOUR = "cast(floor(us / 3600000000.0) as bigint)"


def gaps(key: str, source: str) -> str:
    """key, gap: microseconds between neighbours in time of each key of source (key, us)."""
    return f"""(with h as (select {key}, us, {HOUR} as hr from {source} s),
      i as (select {key}, us - lag(us) over (partition by {key}, hr order by us) as gap from h),
      e as (select {key}, hr, min(us) as a, max(us) as b from h group by {key}, hr),
      j as (select {key}, a - lag(b) over (partition by {key} order by hr) as gap from e)
      select {key}, gap from i where gap is not null union all select {key}, gap from j where gap is not null)"""


def cumulated(key: str, rel: str, *counts: str) -> str:
    """Of rel (key, v, counts), distinct in key and v: with c_<count> running totals by v, n_<count> totals, and nv, the next v.

    Ranges are even in the logarithm of v; as they only rise with v, their edges make no difference.
    """
    kept = "".join(f", {c}" for c in counts)
    sums = "".join(f", sum({c}) as {c}" for c in counts)
    before = "".join(f", sum({c}) over (partition by {key} order by part) - {c} as b_{c}, sum({c}) over (partition by {key}) as n_{c}" for c in counts)
    out = "".join(f", k.{c}, p.b_{c} + sum(k.{c}) over (partition by k.{key}, k.part order by k.v) as c_{c}, p.n_{c}" for c in counts)
    return f"""(with k as (select {key}, v, cast(floor(ln(1.0 + greatest(v, 0)) * 200) as bigint) as part{kept} from {rel} q),
      t as (select {key}, part, min(v) as first_v{sums} from k group by {key}, part),
      p as (select {key}, part, lead(first_v) over (partition by {key} order by part) as next_v{before} from t)
      select k.{key}, k.v{out}, coalesce(lead(k.v) over (partition by k.{key}, k.part order by k.v), p.next_v) as nv from k join p on p.{key} = k.{key} and p.part = k.part)"""


def peak(key: str, spans: str) -> str:
    """key, peak of overlapping (key, a, b) spans; ends come before starts at equal times, so only each time's net change counts."""
    return f"""(with n as (select {key}, us, sum(delta) as net, {HOUR} as hr from (select {key}, a as us, 1 as delta from ({spans}) p union all select {key}, b, -1 from ({spans}) q) u group by {key}, us),
      t as (select {key}, hr, sum(net) as net from n group by {key}, hr),
      p as (select {key}, hr, sum(net) over (partition by {key} order by hr) - net as base from t),
      r as (select n.{key}, p.base + sum(n.net) over (partition by n.{key}, n.hr order by n.us) as running from n join p on p.{key} = n.{key} and p.hr = n.hr)
      select {key}, max(running) as peak from r group by {key})"""


DAY, MINUTE = 86_400_000_000, 60_000_000


def _part(width: int) -> str:
    return f"cast(floor(us / {width}.0) as bigint)"


def before(key: str, source: str, *counts: str, rest: str = "", last: str | None = None, width: int = DAY) -> str:
    """Rows of source (key, us, eid, counts, rest) with b_<count>: totals over the key's rows before them in the order (us, eid).

    last: a column whose value in the row before is returned as prev. A key's rows are ordered
    within days; its days, one row each, carry the totals on.
    """
    w = f"over (partition by {key}, dy order by us, eid rows between unbounded preceding and 1 preceding)"
    own = "".join(f", coalesce(sum({c}) {w}, 0) as i_{c}" for c in counts)
    sums = "".join(f", sum({c}) as {c}" for c in counts)
    carried = "".join(f", coalesce(sum({c}) over (partition by {key} order by dy rows between unbounded preceding and 1 preceding), 0) as o_{c}" for c in counts)
    out = "".join(f", w.i_{c} + p.o_{c} as b_{c}" for c in counts)
    if last:
        own += f", lag({last}) over (partition by {key}, dy order by us, eid) as i_prev"
        sums += f", max(case when r = 1 then {last} end) as last_one"
        carried += f", lag(last_one) over (partition by {key} order by dy) as o_prev"
        out += ", coalesce(w.i_prev, p.o_prev) as prev"
        own += f", row_number() over (partition by {key}, dy order by us desc, eid desc) as r"
    more = f", {rest}" if rest else ""
    picked = f", {', '.join('w.' + c.strip() for c in rest.split(','))}" if rest else ""
    return f"""(with h as (select {key}, us, eid, {_part(width)} as dy{"".join(", " + c for c in counts)}{more} from {source} s0),
      w as (select h.*{own} from h), t as (select {key}, dy{sums} from w group by {key}, dy), p as (select {key}, dy{carried} from t)
      select w.{key}, w.us, w.eid{picked}{out} from w join p on p.{key} = w.{key} and p.dy = w.dy)"""


def beyond(key: str, source: str, hit: str, ahead: bool, rest: str, width: int = DAY) -> str:
    """Rows of source (key, us, hit, rest) with n: the sum of hit over the key's rows strictly later (ahead) or earlier than them.

    As before() a key's rows are ordered within days (or another width), which carry totals; rows at one time count alike.
    """
    frame = "between 1 following and unbounded following" if ahead else "between unbounded preceding and 1 preceding"
    picked = ", ".join("w." + c.strip() for c in rest.split(","))
    return f"""(with h as (select {key}, us, {_part(width)} as dy, {hit} as hit, {rest} from {source} s0),
      w as (select h.*, coalesce(sum(hit) over (partition by {key}, dy order by us range {frame}), 0) as i_n from h), t as (select {key}, dy, sum(hit) as hit from h group by {key}, dy),
      p as (select {key}, dy, coalesce(sum(hit) over (partition by {key} order by dy rows {frame}), 0) as o_n from t)
      select w.{key}, w.us, {picked}, w.i_n + p.o_n as n from w join p on p.{key} = w.{key} and p.dy = w.dy)"""


def nearest(key: str, source: str, ahead: bool, rest: str, width: int = DAY) -> str:
    """Rows of source (key, us, rest) with near_us: the key's nearest strictly later (ahead) or earlier time."""
    near, frame = ("min", "range between 1 following and unbounded following") if ahead else ("max", "range between unbounded preceding and 1 preceding")
    step = "lead(lo)" if ahead else "lag(hi)"
    picked = ", ".join("w." + c.strip() for c in rest.split(","))
    return f"""(with h as (select {key}, us, {_part(width)} as dy, {rest} from {source} s0),
      w as (select h.*, {near}(us) over (partition by {key}, dy order by us {frame}) as i_us from h), t as (select {key}, dy, min(us) as lo, max(us) as hi from h group by {key}, dy),
      p as (select {key}, dy, {step} over (partition by {key} order by dy) as o_us from t)
      select w.{key}, w.us, {picked}, coalesce(w.i_us, p.o_us) as near_us from w join p on p.{key} = w.{key} and p.dy = w.dy)"""


#: So many rows of a key one task may order; only keys with more are cut at days.
LONG = 100_000


def _cut(key: str, source: str, sizes: str, columns: str) -> str:
    """h: source (key, us, base, columns), with dy: the day of rows whose base has over LONG rows in sizes (base), else null. Rows without key or time are left out."""
    return f"""long_ as (select base from {sizes} z0 group by base having count(*) > {LONG}),
      h as (select /*+ broadcast(l) */ s0.{key}, s0.us, {columns}, case when l.base is not null then {_part(DAY)} end as dy from {source} s0 left join long_ l on l.base = s0.base where s0.{key} is not null and s0.us is not null)"""


def before_(key: str, source: str, sizes: str, *counts: str, rest: str, last: str) -> str:
    """before() in Spark, where only long keys are cut: rows are shuffled once, and days carry totals on for long keys alone."""
    w = f"over (partition by {key}, dy order by us, eid rows between unbounded preceding and 1 preceding)"
    own = "".join(f", coalesce(sum({c}) {w}, 0) as i_{c}" for c in counts)
    sums = "".join(f", sum({c}) as {c}" for c in counts)
    carried = "".join(f", coalesce(sum({c}) over (partition by {key} order by dy rows between unbounded preceding and 1 preceding), 0) as o_{c}" for c in counts)
    out = "".join(f", w.i_{c} + coalesce(p.o_{c}, 0) as b_{c}" for c in counts)
    picked = ", ".join("w." + c.strip() for c in rest.split(","))
    return f"""(with {_cut(key, source, sizes, ', '.join(('eid', *counts, rest)))},
      w as (select h.*{own}, lag({last}) over (partition by {key}, dy order by us, eid) as i_prev from h),
      t as (select {key}, dy{sums}, max_by({last}, struct(us, eid)) as last_one from h where dy is not null group by {key}, dy),
      p as (select {key}, dy{carried}, lag(last_one) over (partition by {key} order by dy) as o_prev from t)
      select w.{key}, w.us, w.eid, {picked}{out}, coalesce(w.i_prev, p.o_prev) as prev from w left join p on p.{key} = w.{key} and p.dy = w.dy)"""


def beyond_(key: str, source: str, sizes: str, ahead: bool, rest: str) -> str:
    """beyond() in Spark of source (key, us, base, hit, rest), where only long keys are cut, as in before_()."""
    frame = "between 1 following and unbounded following" if ahead else "between unbounded preceding and 1 preceding"
    picked = ", ".join("w." + c.strip() for c in rest.split(","))
    return f"""(with {_cut(key, source, sizes, f'hit, {rest}')},
      w as (select h.*, coalesce(sum(hit) over (partition by {key}, dy order by us range {frame}), 0) as i_n from h),
      t as (select {key}, dy, sum(hit) as hit from h where dy is not null group by {key}, dy),
      p as (select {key}, dy, coalesce(sum(hit) over (partition by {key} order by dy rows {frame}), 0) as o_n from t)
      select w.{key}, w.us, {picked}, w.i_n + coalesce(p.o_n, 0) as n from w left join p on p.{key} = w.{key} and p.dy = w.dy)"""
