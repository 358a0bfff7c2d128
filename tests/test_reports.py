"""Coverage, confidence and timing reports against values worked out apart from the SQL."""

import math
import random
import statistics
from collections import defaultdict

import pytest

from ocspark.operators import arcs, reports
from ocspark.operators.arcs import Arc
from ocspark.plans.dialect import SPARK
from ocspark.registry import doubles
from ocspark.sources.registered import small_log

ARCS = [Arc("A", "B", "EF", each=("C",), nmin=1, nmax=2), Arc("B", "D", "EP", each=("V",))]
EVENTS = "a,A,1,c1; a2,A,2,c2; b,B,3,c1 v1"


def rows(log, write):
    return [r.asDict() for r in log.sql(doubles(write(SPARK, ARCS))).collect()]


def test_coverage(spark):
    got = {r["score"]: r["value"] for r in rows(small_log(spark, EVENTS), arcs.coverage_sql)}
    assert got == pytest.approx({"activity": 2 / 3, "object_type": 1, "source_activation": 1, "non_vacuous": 1, "object_presence": 1, "finite_boundary": 0.25, "matching_event": 0.5}, abs=1e-6)


def test_coverage_without_activations(spark):
    got = {r["score"]: r["value"] for r in rows(small_log(spark, "x,X,1,c1"), arcs.coverage_sql)}
    assert got == {"activity": 0, "object_type": 0.5, "source_activation": 0, "non_vacuous": 0, "object_presence": None, "finite_boundary": None, "matching_event": 0}


def test_confidence_report(spark):
    got = rows(small_log(spark, EVENTS + "; b2,B,4,c2"), arcs.confidence_report_sql)
    one, two = sorted(got, key=lambda r: r["constraint_id"])
    assert (one["n_activations"], one["n_satisfied"], one["n_vacuous_activations"], one["confidence"], one["mean_binding_count"], one["each_types"], one["nmax"]) == (2, 2, 0, 1.0, 1.0, "C", 2)
    assert (two["n_activations"], two["n_satisfied"], two["n_violating"], two["n_vacuous_activations"], two["confidence"], two["mean_binding_count"], two["nmax"]) == (2, 1, 1, 1, 0.5, 0.0, None)


def timing(events, share):
    """activity -> statistics, event by event."""
    lines = defaultdict(list)
    for eid, _, t, os in events:
        for o in os:
            lines[o].append((t, eid))
    at = {(o, e): i for o, line in lines.items() for i, (_, e) in enumerate(sorted(line))}
    by = defaultdict(lambda: defaultdict(list))
    for eid, act, t, os in events:
        prev = [sorted(lines[o])[at[o, eid] - 1][0] for o in os if at[o, eid] > 0]
        by[act]["next"] += [(sorted(lines[o])[at[o, eid] + 1][0] - t) / 1e6 for o in os if at[o, eid] + 1 < len(lines[o])]
        by[act]["sojourn"].append((t - max(prev)) / 1e6 if prev else 0.0)
        by[act]["flow"].append((t - min(prev)) / 1e6 if prev else 0.0)
        if prev:
            by[act]["sync"].append((max(prev) - min(prev)) / 1e6)
    out = {}
    for act, x in by.items():
        pos = [v for v in x["sojourn"] if v > 0]
        mid = lambda v: sorted(v)[len(v) // 2]
        raw = x["next"] if x["next"] and (not pos or mid(x["next"]) <= mid(pos)) else pos or x["next"] or x["sojourn"]
        low = sorted(raw)[: max(1, math.ceil(share * len(raw)))]
        out[act] = {
            "sample_count": len(x["sojourn"]), "service_count": len(low), "service_mean": statistics.mean(low), "service_std": statistics.pstdev(low), "service_min": low[0], "service_max": low[-1],
            "sojourn_mean": statistics.mean(x["sojourn"]), "sojourn_std": statistics.pstdev(x["sojourn"]), "flow_mean": statistics.mean(x["flow"]), "flow_std": statistics.pstdev(x["flow"]),
            "sync_mean": statistics.mean(x["sync"] or [0.0]), "sync_std": statistics.pstdev(x["sync"] or [0.0]), "waiting_mean": max(0.0, statistics.mean(x["sojourn"]) - statistics.mean(low)),
        }
    return out, {a: (len(x["next"]), sorted(x["next"])[len(x["next"]) // 2]) for a, x in by.items() if x["next"]}


@pytest.mark.parametrize("seed,mode,share", [(1, "p25", 0.25), (2, "p50", 0.5), (3, "all", 1.0)])
def test_timing(spark, seed, mode, share):
    rnd = random.Random(seed)
    times = rnd.sample(range(10**6, 10**9), 80)
    events = [(f"e{i}", rnd.choice("ABCDE") if i % 9 else "Z", t, sorted(rnd.sample(["c1", "c2", "c3", "c4", "v1", "v2", "v3"], rnd.randint(1, 3)))) for i, t in enumerate(times)] + [("last", "End", 10**9 + 5, ["c1", "v1"])]
    log = small_log(spark, "; ".join(f"{e},{a},{t},{' '.join(os)}" for e, a, t, os in events))
    want, medians = timing(events, share)
    got = {r.activity: r.asDict() for r in reports.ocpa_statistics(log, mode=mode).collect()}
    assert set(got) == set(want)
    for a, x in want.items():
        assert {k: got[a][k] for k in x} == pytest.approx(x, abs=1e-4), a
    assert {r.activity: (r.n, round(r.upper_median, 6)) for r in reports.upper_medians(log).collect()} == {a: (n, round(v, 6)) for a, (n, v) in medians.items()}


def test_timing_of_equal_logs(spark):
    log = small_log(spark, "a,A,1000000,c1 v1; b,B,3000000,c1; d,A,9000000,c1; e,B,9500000,v1")
    assert {r.wmape for r in reports.ocpa_wmape(log, log).collect()} == {0.0}
    one = reports.wasserstein_summary(log, log).first()
    assert (one.w1_weighted, one.activities_scored, one.coverage_reference) == (0.0, 2, 1.0)
