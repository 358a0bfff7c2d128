"""Full timing statistics of a log, and the comparisons of two logs that rest on them."""

from __future__ import annotations

from ..plans import cuts
from ..registry import comparison, operator
from .measures import _DIRECT, _TIMES, _area, chosen_samples, _z

#: The compared times of an activity.
FIELDS = ("service_mean", "service_min", "service_max", "waiting_mean", "sojourn_mean", "sync_mean", "flow_mean", "pooling_mean", "lagging_mean")


def _statistics(mode: str) -> str:
    """A row for each activity; without any earlier event of its objects synchronisation is 0. Pooling spans all types' arrivals, as synchronisation does, so no type lags behind."""
    return f"""select t.activity, t.sample_count, sojourn_mean, sojourn_std, sojourn_min, sojourn_max, sync_mean, sync_std, flow_mean, flow_std, sync_mean as pooling_mean, 0.0 as lagging_mean,
      greatest(0, sojourn_mean - s.service_mean) as waiting_mean, sojourn_std as waiting_std, s.service_mean, s.service_std, s.service_min, s.service_max, s.service_source, s.service_count
      from (select activity, count(*) as sample_count, avg(sojourn) as sojourn_mean, stddev_pop(sojourn) as sojourn_std, min(sojourn) as sojourn_min, max(sojourn) as sojourn_max, coalesce(avg(sync), 0.0) as sync_mean,
        coalesce(stddev_pop(sync), 0.0) as sync_std, avg(flow) as flow_mean, stddev_pop(flow) as flow_std from ({_TIMES}) x group by activity) t
      join (select activity, max(source) as service_source, cast(sum(w) as bigint) as service_count, sum(v * w) / sum(w) as service_mean, sqrt(greatest(0, sum(w * v * v) / sum(w) - (sum(v * w) / sum(w)) * (sum(v * w) / sum(w)))) as service_std,
        min(v) as service_min, max(v) as service_max from ({chosen_samples(mode)}) c group by activity) s on s.activity = t.activity"""


@operator("u", mode="p25")
def ocpa_statistics(d, mode):
    names = [f"{m}_{s}" for m in ("sojourn", "sync", "flow", "service") for s in ("mean", "std")] + ["sojourn_min", "sojourn_max", "service_min", "service_max", "pooling_mean", "lagging_mean", "waiting_mean", "waiting_std"]
    return f"select activity, sample_count, service_source, service_count, {', '.join(f'round({n}, 4) as {n}' for n in names)} from ({_statistics(mode)}) s"


@operator("u")
def upper_medians(d):
    """The upper median of each activity's times to its objects' next events: of n samples that of rank floor(n / 2) from 0."""
    counted = cuts.cumulated("activity", f"(select activity, v, count(*) as x from ({_DIRECT}) r group by activity, v)", "x")
    return f"select activity, cast(n_x as bigint) as n, v as upper_median from {counted} m where c_x - x < floor(n_x / 2.0) + 1 and c_x >= floor(n_x / 2.0) + 1"


def _paired(d, mode: str) -> str:
    """activity, field, a, b of two logs; null where a log lacks the activity. Each log's statistics stand in the plan once."""
    one = _statistics(mode)
    pick = lambda side: "case " + " ".join(f"when k.n = {i} then {side}.{f}" for i, f in enumerate(FIELDS)) + " end"
    name = "case " + " ".join(f"when k.n = {i} then '{f}'" for i, f in enumerate(FIELDS)) + " end"
    return f"select coalesce(a.activity, b.activity) as activity, {name} as field, {pick('a')} as a, {pick('b')} as b from ({one}) a full outer join ({_z(one)}) b on a.activity = b.activity cross join {d.numbers('0', str(len(FIELDS) - 1))} k"


@comparison("ocpa_fields", mode="p25")
def ocpa_fields(d, mode):
    """Each of nine times of each activity in both logs, and the difference in percent of the first."""
    return f"select activity, field, round(a, 4) as reference, round(b, 4) as simulated, round(100.0 * (b - a) / nullif(abs(a), 0), 1) as pct_diff from ({_paired(d, mode)}) p"


@comparison("ocpa_wmape", mode="p25")
def ocpa_wmape(d, mode):
    """Sum of differences in percent of the sum of times: of each activity over times with a positive reference, and ('') over all where neither is 0."""
    share = lambda cond: f"100.0 * sum(case when {cond} then abs(b - a) end) / nullif(sum(case when {cond} then a end), 0)"
    return f"""select coalesce(activity, '') as activity, round(case when grouping(activity) = 1 then {share('a > 0 and b <> 0')} else {share('a > 0 and b is not null')} end, 1) as wmape
      from ({_paired(d, mode)}) p group by grouping sets ((activity), ())"""


@comparison("wasserstein_summary", mode="p25")
def wasserstein_summary(d, mode):
    """Distances of the selected service samples (hours): weighted by the first log's samples, mean, median, and the share of samples that were scored."""
    hours = f"select activity, v / 3600.0 as v, w from ({chosen_samples(mode)}) s"
    each = f"""(select activity, max(nx) as n, max(ny) as m, sum(abs(cx * 1.0 / nx - cy * 1.0 / ny) * coalesce(nv - v, 0)) as w1 from ({_area(hours, _z(hours), "select * from c").replace("1 as x, 0 as y", "w as x, 0 as y").replace("0, 1 from", "0, w from")}) c group by activity)"""
    return f"""select cast(sum(case when n > 0 and m > 0 then 1 else 0 end) as bigint) as activities_scored, count(*) as activities_total, round(sum(case when n > 0 and m > 0 then w1 * n end) / sum(case when n > 0 and m > 0 then n end), 6) as w1_weighted,
      round(avg(case when n > 0 and m > 0 then w1 end), 6) as w1_mean, round(median(case when n > 0 and m > 0 then w1 end), 6) as w1_median,
      round(sum(case when m > 0 then n else 0 end) * 1.0 / nullif(sum(n), 0), 6) as coverage_reference, round(sum(case when n > 0 then m else 0 end) * 1.0 / nullif(sum(m), 0), 6) as coverage_simulated from {each} e"""


@comparison("gap_fidelity")
def gap_fidelity(d):
    """Mean and upper median (s) of the gaps between an activity's events, in both logs."""
    one = lambda ev: f"""select activity, sum(v * x) / sum(x) as mean_v, max(case when c_x - x < floor(n_x / 2.0) + 1 and c_x >= floor(n_x / 2.0) + 1 then v end) as median_v
      from {cuts.cumulated('activity', f"(select activity, gap / 1e6 as v, count(*) as x from {cuts.gaps('activity', ev)} g group by activity, gap)", 'x')} k group by activity"""  # noqa: E731
    return f"select coalesce(a.activity, b.activity) as activity, round(a.mean_v, 2) as mean_reference, round(b.mean_v, 2) as mean_simulated, round(a.median_v, 2) as median_reference, round(b.median_v, 2) as median_simulated from ({one('{ev}')}) a full outer join ({one('{z_ev}')}) b on a.activity = b.activity"
