"""Stateful monitors: results of a stream cut into batches in any way equal those of the whole log in order."""

import random

import pytest
from pyspark.sql import functions as F

from ocspark.streaming import monitors, state
from ocspark.streaming.registered import replay

HOUR = 3_600_000_000


def rows_of(spark, events):
    """(oid, eid, activity, hours, part)"""
    df = spark.createDataFrame([(o, e, a, h * HOUR, p) for o, e, a, h, p in events], "oid string, eid string, activity string, us long, part int")
    return df.select("oid", "eid", "activity", F.timestamp_micros("us").alias("ts"), "part")


def brute_prefix(events, nmin, nmax):
    rules, out = state.prefix_rules("A", nmin, nmax), set()
    by = {}
    for o, e, a, h, _ in sorted(events, key=lambda x: (x[3], x[1])):
        before = by.setdefault(o, [])
        ns, nt = before.count("A"), before.count("B")
        out.add((e, tuple(k for k, rule in rules.items() if rule(a == "A", a == "B", ns, nt, before[-1] if before else None))))
        before.append(a)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_state_of_shuffled_arrivals(spark, seed):
    """Rows a day late are taken in; rows that are too late are dropped; cut into batches at random."""
    rng = random.Random(seed)
    events = []
    for i in range(150):
        h = rng.randrange(10, 400)
        events.append((f"o{rng.randrange(6)}", f"e{i:03}", rng.choice("ABD"), h, min(2, h // 140) + (rng.random() < 0.1 and h % 140 > 120)))
    events.append(("o1", "late", "A", 1, 2))  # two weeks behind
    got = {(r.eid, tuple(r.refused)) for r in replay(rows_of(spark, events), lambda s: state.prefix_monitor(s, "A", "B", 1, 2, late="1 day"), 4).where("oid <> ''").collect()}
    assert got == brute_prefix(events[:-1], 1, 2)


def test_idle_objects_are_forgotten(spark):
    events = [("o1", "e1", "A", 10, 0), ("o1", "e2", "B", 15, 0), ("o1", "e3", "B", 110, 1), ("o2", "e4", "A", 100, 1), ("o2", "e5", "B", 111, 1)]
    got = {r.eid: r.refused for r in replay(rows_of(spark, events), lambda s: state.prefix_monitor(s, "A", "B", late="1 hour", idle_us=50 * HOUR), 2).where("oid <> ''").collect()}
    assert "precedence" not in got["e2"] and "precedence" in got["e3"] and "precedence" not in got["e5"]


def brute_obligations(events, nmin, horizon, ends):
    out = []
    for o, e, a, h, _ in events:
        if a != "A":
            continue
        left, verdict, at = nmin, "violated", None
        for h2, e2, a2 in sorted((y[3], y[1], y[2]) for y in events if y[0] == o and (y[3], y[1]) > (h, e)):
            if h2 > h + horizon:
                break
            if a2 == "B" and h2 > h:
                left -= 1
                if not left:
                    verdict, at = "fulfilled", h2 * HOUR
                    break
            if a2 in ends:
                verdict = "cancelled"
                break
        out.append((o, h * HOUR, at, verdict))
    return sorted(out, key=repr)


@pytest.mark.parametrize("nmin", [1, 2])
def test_obligations(spark, nmin):
    rng = random.Random(nmin)
    events = []
    for i in range(160):
        h = rng.randrange(1, 300)
        events.append((f"o{rng.randrange(8)}", f"e{i:03}", rng.choice("AABBBDEE"), h, min(2, h // 100) + (rng.random() < 0.1 and h % 100 > 85)))
    said = replay(rows_of(spark, events), lambda s: state.obligation_monitor(s, "A", "B", ("E",), nmin, 20 * HOUR, late="1 day"), 4)
    got = sorted(((r.oid, r.activation_us, r.response_us, r.verdict) for r in said.collect()), key=repr)
    assert got == brute_obligations(events, nmin, 20, {"E"})
    assert {v for *_, v in got} == {"fulfilled", "violated", "cancelled"}


def test_windows_take_late_rows_and_drop_later_ones(spark):
    events = [("o1", "e1", "A", 0, 0), ("o1", "e2", "A", 50, 0), ("o1", "e3", "A", 49, 1), ("o1", "e4", "A", 1, 1), ("o2", "e5", "B", 120, 1)]
    got = {(r.start.timestamp() / 3600, r.activity): r.n for r in replay(rows_of(spark, events), lambda s: monitors.windowed_counts(s, "10 hours", late="1 day"), 2).where("activity <> ''").collect()}
    assert got == {(0.0, "A"): 1, (40.0, "A"): 1, (50.0, "A"): 1, (120.0, "B"): 1}


def test_late_event_joins_a_session(spark):
    """One that still counts, and falls within the gap of a session whose window is behind the watermark, lengthens it; one that comes too late doesn't."""
    events = [("o1", "e1", "A", 10, 0), ("o1", "e2", "A", 15, 0), ("o2", "e3", "A", 48, 0), ("o3", "e4", "A", 16, 1), ("o1", "e5", "A", 25, 1), ("o1", "e6", "A", 20, 1), ("o4", "e7", "A", 12, 1), ("o1", "e8", "A", 37, 1)]
    said = replay(rows_of(spark, events), lambda s: monitors.sessions(s, "12 hours", late="20 hours"), 2).where("oid <> ''")
    got = {(r.oid, r.a // HOUR, r.b // HOUR, r.n) for r in said.select("oid", F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b"), "n").collect()}
    assert got == {("o1", 10, 37, 4), ("o1", 37, 49, 1), ("o2", 48, 60, 1)}
