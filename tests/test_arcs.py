"""Count semantics of arcs on small logs written out by hand, and against a brute-force checker."""

import random
from itertools import product

import pytest

from ocspark.log import EventLog
from ocspark.operators.arcs import Arc, apply_bounds, bindings, support
from ocspark.operators import mining, params

TYPES = {"c1": "C", "c2": "C", "v1": "V", "v2": "V"}


def make(spark, events):
    ev = spark.createDataFrame([(e, a, h * 3_600_000_000) for e, a, h, _ in events], "eid string, activity string, us long")
    e2o = spark.createDataFrame([(e, o, TYPES[o]) for e, _, _, os in events for o in os.split()], "eid string, oid string, otype string")
    ob = spark.createDataFrame(list(TYPES.items()), "oid string, otype string")
    return EventLog(ev, ob, e2o, spark.createDataFrame([], "src string, dst string, qualifier string"))


def counts(log, arc):
    return sorted(r.n for r in bindings(log, arc).collect())


def test_before_and_after(spark):
    log = make(spark, [("a", "A", 1, "c1"), ("b1", "B", 2, "c1"), ("b2", "B", 3, "c1")])
    assert counts(log, Arc("B", "A", "EP", each=("C",))) == [1, 1]
    assert counts(log, Arc("A", "B", "EF", each=("C",))) == [2]


def test_scopes(spark):
    log = make(spark, [("a", "A", 1, "c1 c2 v1 v2"), ("b1", "B", 2, "c1 v1"), ("b2", "B", 3, "c2 v2")])
    assert counts(log, Arc("A", "B", "EF", each=("C", "V"))) == [0, 0, 1, 1]
    assert counts(log, Arc("A", "B", "EF", all_=("C",))) == [0]
    assert counts(log, Arc("A", "B", "EF", any_=("C",))) == [2]


def test_direct_keeps_ties_and_sees_other_activities(spark):
    events = [("a", "A", 1, "c1"), ("x", "D", 2, "c2"), ("b1", "B", 3, "c1"), ("b2", "B", 3, "c1")]
    df, dp = Arc("A", "B", "DF", each=("C",)), Arc("B", "A", "DP", each=("C",))
    log = make(spark, events)
    assert counts(log, df) == [2] and counts(log, dp) == [1, 1]
    log = make(spark, [*events, ("y", "D", 2, "c1")])
    assert counts(log, df) == [0] and counts(log, dp) == [0, 0]


def test_equal_times_are_simultaneous(spark):
    log = make(spark, [("a", "A", 2, "c1"), ("b", "B", 2, "c1")])
    assert [counts(log, Arc("A", "B", t, each=("C",))) for t in ("EF", "EP", "DF", "DP", "AS")] == [[0], [0], [0], [0], [1]]


def test_no_evidence_is_not_zero(spark):
    log = make(spark, [("a", "A", 1, "c1")])
    assert counts(log, Arc("A", "B", "EF", each=("C",))) == [0]
    assert counts(log, Arc("B", "A", "EF", each=("C",))) == []
    assert support(log, Arc("B", "A", "EF", each=("C",))).first().support is None


def test_bad_arcs():
    with pytest.raises(ValueError):
        Arc("A", "B", "XX", each=("C",))
    with pytest.raises(NotImplementedError):
        Arc("A", "B", "EF", each=("C>V",))
    assert apply_bounds([Arc("A", "B", each=("C",))], [(None, None)])[0].nmin == 1
    assert apply_bounds([Arc("A", "B", each=("C",))], [(2, 3)])[0].nmax == 3


def brute(events, a):
    by = {e: (act, h, set(os.split())) for e, act, h, os in events}
    out = []
    for act, h, os in by.values():
        if act != a.src:
            continue
        own = lambda t: [o for o in sorted(os) if TYPES[o] == t]
        for combo in product(*[own(t) for t in a.each]):
            req = set(combo).union(*[own(t) for t in a.all_]) if a.all_ else set(combo)
            met = [x for x in by.values() if req <= x[2] and all(set(own(t)) & x[2] for t in a.any_)]
            if a.arc in ("EF", "DF"):
                met = [x for x in met if x[1] > h]
            elif a.arc in ("EP", "DP"):
                met = [x for x in met if x[1] < h]
            if a.arc in ("DF", "DP") and met:
                near = (min if a.arc == "DF" else max)(x[1] for x in met)
                met = [x for x in met if x[1] == near]
            out.append(sum(x[0] == a.tgt for x in met))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    events = [(f"e{i}", rng.choice("AB"), rng.randint(1, 6), " ".join(rng.sample(sorted(TYPES), rng.randint(1, 4)))) for i in range(14)]
    log = make(spark, events)
    for t in ("AS", "EF", "DP"):
        for scope in ({"each": ("C",)}, {"each": ("C", "V")}, {"each": ("C",), "any_": ("V",)}):
            arc = Arc("A", "B", t, **scope)
            assert counts(log, arc) == brute(events, arc), (t, scope)


def test_parameters_of_the_manuscript_log(spark):
    """Twenty events on ten manuscripts, S submits and R reviews; the numbers are worked out by hand."""
    order = "S1 S1 R1 S2 R2 R2 S3 R4 S5 R5 S6 R6 S7 R7 S8 R8 S9 R9 S10 R10".split()
    day = 86_400_000_000
    start = 20454 * day + 9 * 3_600_000_000  # 2026-01-01 09:00
    ev = spark.createDataFrame([(f"e{i:02}", x[0], start + i * day) for i, x in enumerate(order)], "eid string, activity string, us long")
    e2o = spark.createDataFrame([(f"e{i:02}", "m" + x[1:], "manuscript") for i, x in enumerate(order)], "eid string, oid string, otype string")
    ob = spark.createDataFrame([(f"m{k}", "manuscript") for k in range(1, 11)], "oid string, otype string")
    log = EventLog(ev, ob, e2o, spark.createDataFrame([], "src string, dst string, qualifier string"))
    s = lambda a, b, t: support(log, Arc(a, b, t, each=("manuscript",))).first().support
    assert [s("S", "R", t) for t in ("AS", "EF", "EP", "DF", "DP")] == [0.9, 0.9, 0.0, 0.8, 0.0]
    assert [s("R", "S", t) for t in ("AS", "EF", "EP", "DF", "DP")] == [0.9, 0.0, 0.9, 0.0, 0.8]
    assert {(r.a, r.b): r.p for r in params.transition_oc(log).collect()} == {("S", "R"): 0.8}
    assert {r.activity: r.position for r in params.trace_position(log).collect()} == {"S": 0.05, "R": 0.85}
    assert {r.activity for r in params.lifecycle_creates(log, threshold=0.9).collect()} == {"S"}
    assert {r.activity: r.mean_s for r in params.interarrival(log).collect()} == {"S": 172800.0, "R": 163200.0}
    assert params.wip_peak(log).first().peak == 1
    got = {(r.activity, r.slot): r.share for r in params.calendar_slots(log).collect() if r.share}
    assert {k for _, k in got} <= {57, 9, 33, 81, 105, 129, 153}


def test_discovery_scopes_and_resources(spark):
    """Against supports counted arc by arc: any, each and all, a large source event, a resource."""
    hour, events, links = 3_600_000_000, [], []

    def add(eid, activity, h, *objects):
        events.append((eid, activity, h * hour))
        links.extend((eid, o, o[0].upper()) for o in objects)

    for i in range(5):
        c = [f"c{i}_{k}" for k in range(25 if i == 0 else 2)]
        add(f"a{i}", "A", 10 * i, *c, "r0")
        add(f"b{i}", "B", 10 * i + 1, c[0], "r0")  # one of A's objects
        for k, o in enumerate(c):
            add(f"d{i}_{k}", "D", 10 * i + 2, o, "r0")  # each of A's objects, by an event of its own
        add(f"e{i}", "E", 10 * i + 3, *c, "r0")  # all of them at once
    log = EventLog(
        spark.createDataFrame(events, "eid string, activity string, us long"), spark.createDataFrame(sorted({(o, t) for _, o, t in links}), "oid string, otype string"),
        spark.createDataFrame(links, "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )
    rows = {(r.otype, r.src, r.tgt): r for r in mining.pair_supports(log).collect()}
    for tgt in "BDE":
        for scope in mining.SCOPES:
            for t in ("AS", "EF", "EP"):
                arc = mining.replace(mining.scoped("A", tgt, "C", scope), arc=t)
                assert rows["C", "A", tgt][f"{t}_{scope}"] == support(log, arc).first().satisfied, arc
    got = {(a.src, a.tgt, a.arc, a.any_, a.each, a.all_) for a, _ in mining.discover(log)}
    # labels are joined: r0 meets 33 D events, but one with each of A's objects
    assert ("A", "B", "EF", ("C",), ("R",), ()) in got and ("A", "D", "EF", (), ("C", "R"), ()) in got and ("A", "E", "EF", (), ("R",), ("C",)) in got
    alone = mining.label_supports(log, 0.2)["A", "D"][(("R", "each"),)]
    assert alone["AS"] == alone["total"] and alone["few"] == 0
    assert any(tgt == "D" and "R" in a.each for a, _ in mining.discover(log, most_events=None) for tgt in a.tgt)
