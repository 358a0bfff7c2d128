"""Joint labels, reduction, arcs without types, joint prefixes and draws, against brute force on small logs."""

import itertools
import random
import threading
import time

import numpy as np
import pytest

from ocspark.log import EventLog
from ocspark.operators import mining, sampling
from ocspark.operators.arcs import Arc, bindings, prefix_joint, prefix_rules, support
from ocspark.operators.joint import joint_supports


def log_of(spark, events):
    """events: (eid, activity, us, objects); an object's type is its first letter."""
    links = sorted({(e, o, o[0].upper()) for e, _, _, os in events for o in os})
    return EventLog(
        spark.createDataFrame([(e, a, t) for e, a, t, _ in events], "eid string, activity string, us long"), spark.createDataFrame(sorted({(o, t) for _, o, t in links}), "oid string, otype string"),
        spark.createDataFrame(links, "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )


def some_events(seed, n=60):
    rng = random.Random(seed)
    return [(f"e{i:03}", rng.choice("ABD"), rng.randrange(40) * 40_000_000_000, tuple(sorted(rng.sample(["p0", "p1", "p2", "q0", "q1", "r0", "r1", "r2"], rng.randint(1, 5))))) for i in range(n)]


def counts(events, a, tgt, labels, arc="AS"):
    """Target events of each binding of an event."""
    _, _, us, objects = a
    of = lambda t: [o for o in objects if o[0].upper() == t]
    out = []
    for each in itertools.product(*[of(t) for t, s in labels if s == "each"]):
        need = {*each, *(o for t, s in labels if s == "all" for o in of(t))}
        n = 0
        for b in events:
            n += b[1] == tgt and need <= set(b[3]) and all(set(of(t)) & set(b[3]) for t, s in labels if s == "any") and (arc == "AS" or (b[2] > us if arc == "EF" else b[2] < us))
        out.append(n)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_joint_supports_by_brute_force(spark, seed):
    events = some_events(seed)
    scopes = ("any", "each", "all")
    candidates = [(src, tuple(zip(ts, ss, strict=True))) for src in "AB" for ts in (("P", "Q"), ("P", "R"), ("P", "Q", "R")) for ss in itertools.product(scopes, repeat=len(ts))]
    got = {(candidates[r.candidate], r.tgt): r for r in joint_supports(log_of(spark, events), candidates, most_events=2).collect()}
    for (src, labels), tgt in itertools.product(candidates, "ABD"):
        if src == tgt:
            continue
        acts = [a for a in events if a[1] == src and all(any(o[0].upper() == t for o in a[3]) for t, _ in labels)]
        want = {t: sum(min(counts(events, a, tgt, labels, t)) > 0 for a in acts) for t in ("AS", "EF", "EP")}
        few = sum(all(1 <= n <= 2 for n in counts(events, a, tgt, labels)) for a in acts)
        r = got.get(((src, labels), tgt))
        if r is None:
            assert want["AS"] == 0
            continue
        assert (r.total, r.AS, r.EF, r.EP) == (len(acts), want["AS"], want["EF"], want["EP"]), (src, labels, tgt)
        assert r.few <= few <= r.few_most and (r.few == few or any(s == "any" for _, s in labels))


def brute_discovery(events, noise, most):
    """Algorithm of the lattice on Python sets: what holds with AS, all unions, then what is implied goes, then resources."""
    rank = {"any": 0, "each": 1, "all": 2}
    out = set()
    for src, tgt in itertools.permutations("ABD", 2):
        def share(labels, ok):
            acts = [a for a in events if a[1] == src and all(any(o[0].upper() == t for o in a[3]) for t, _ in labels)]
            return bool(acts) and sum(all(ok(n) for n in counts(events, a, tgt, labels)) for a in acts) >= (1 - noise) * len(acts) - 1e-12

        held = set()
        for t in "PQR":
            several = any(sum(o[0].upper() == t for o in a[3]) > 1 for a in events if a[1] == src)
            for s in ("any", "each", "all") if several else ("each",):
                if not share(((t, s),), lambda n: n > 0):
                    break
                held.add(((t, s),))
        seen = set(held)
        grown = True
        while grown:
            grown = False
            for a, b in itertools.combinations(sorted(held), 2):
                u = dict(a)
                for t, s in b:
                    u[t] = max(s, u.get(t, s), key=rank.get)
                u = tuple(sorted(u.items()))
                if u not in seen:
                    seen.add(u)
                    if share(u, lambda n: n > 0):
                        held.add(u)
                        grown = True
        implied = lambda x, y: x != y and all(t in dict(y) and rank[dict(y)[t]] >= rank[s] for t, s in x)
        out |= {(src, tgt, x) for x in held if not any(implied(x, y) for y in held) and share(x, lambda n: 1 <= n <= most)}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_discovery_of_joint_labels_by_brute_force(spark, seed):
    events = some_events(seed, 50)
    found = mining.discover(log_of(spark, events), noise=0.6, arrows=(), most_events=6, reduction=False)
    got = {(a.src, a.tgt, tuple(sorted([(t, "any") for t in a.any_] + [(t, "each") for t in a.each] + [(t, "all") for t in a.all_]))) for a, _ in found}
    assert got == brute_discovery(events, 0.6, 6)
    assert any(len(names) > 1 for *_, names in got)


def test_paths_of_any_arcs_dont_stand_for_any_arcs():
    arc = lambda a, b, **k: (Arc(a, b, "EF", **(k or {"each": ("P",)})), 1.0)
    some = {"any_": ("P",)}
    chain = [arc("A", "B", **some), arc("B", "D", **some), arc("A", "D", **some)]
    assert mining.lossless(chain) == chain  # the second any arc may go by another object
    assert [a.tgt for a, _ in mining.lossless([chain[0], arc("B", "D"), chain[2]])] == ["B", "D"]
    assert mining.lossless([arc("A", "B"), arc("B", "D"), arc("A", "D")]) == [arc("A", "B"), arc("B", "D")]
    assert mining.lossless([arc("A", "A")]) == []


def test_arcs_without_types(spark):
    events = some_events(5) + [("f1", "A", 0, ()), ("f2", "B", 39 * 40_000_000_000, ())]
    log = log_of(spark, events)
    for kind in ("AS", "EF", "EP", "DF", "DP"):
        got = {r.eid: r.n for r in bindings(log, Arc("A", "B", kind)).collect()}
        for e, a, us, _ in events:
            if a != "A":
                continue
            others = [b for b in events if kind == "AS" or (b[2] > us if kind[1] == "F" else b[2] < us)]
            if kind in ("DF", "DP") and others:
                near = (min if kind == "DF" else max)(b[2] for b in others)
                others = [b for b in others if b[2] == near]
            assert got.pop(e) == sum(b[1] == "B" for b in others)
        assert not got
    assert support(log, Arc("A", "B", "AS")).first().support == 1.0


def test_joint_prefixes_by_brute_force(spark):
    events = [e for e in some_events(6, 80)]
    got = {r.template: (r.refused, r.events) for r in prefix_joint(log_of(spark, events), src="A", tgt="B", types=("P", "R"), nmin=1, nmax=2).collect()}
    joint = ("precedence", "response_cap", "chain_precedence", "chain_response", "chain_succession")
    assert len(got) == len(prefix_rules("A", "B", 1, 2)) == 17
    ordered = sorted(events, key=lambda e: (e[2], e[0]))

    def refused(template, e, objects):
        before = [b for b in ordered[: ordered.index(e)] if objects <= set(b[3])]
        ns, nt = (sum(b[1] == x for b in before) for x in "AB")
        s, t, prev = e[1] == "A", e[1] == "B", before[-1][1] if before else None
        rules = {
            "precedence": t and ns < 1, "response_cap": t and nt >= 2, "chain_precedence": t and prev != "A", "chain_response": prev == "A" and not t, "not_coexistence": t and ns > 0 or s and nt > 0, "not_succession": t and ns > 0,
            "not_precedence": t and ns > 0, "not_chain_succession": t and prev == "A", "absence": s and ns >= 2, "exactly": s and ns >= 1, "init": not t and nt == 0, "exclusive_choice": s and nt > 0 or t and ns > 0,
            "alternate_response": s and ns > nt, "alternate_precedence": t and nt >= ns,
        }
        rules |= {"succession": rules["precedence"] or rules["response_cap"], "chain_succession": rules["chain_precedence"] or rules["chain_response"], "alternate_succession": rules["alternate_response"] or rules["alternate_precedence"]}
        return rules[template]

    for template, (n, total) in got.items():
        of = lambda e, t: [o for o in e[3] if o[0].upper() == t]
        each = [(e, [{p, r} for p in of(e, "P") for r in of(e, "R")] if template in joint else [{o} for o in of(e, "P") + of(e, "R")]) for e in ordered]
        each = [(e, xs) for e, xs in each if xs]
        assert (n, total) == (sum(any(refused(template, e, x) for x in xs) for e, xs in each), len(each)), template


def test_discovery_can_be_cancelled(spark):
    log = log_of(spark, some_events(7, 60))
    seen, raised = [], []
    started = threading.Event()

    def run():
        spark.sparkContext.setJobGroup("discovery-under-test", "discovery", interruptOnCancel=True)
        try:
            for _ in range(50):
                mining.discover(log, noise=0.6, progress=lambda *x: (seen.append(x), started.set()))
        except Exception as e:
            raised.append(str(e))

    from pyspark import InheritableThread

    t = InheritableThread(target=run)
    t.start()
    assert started.wait(60)
    time.sleep(0.5)
    for _ in range(100):
        spark.sparkContext.cancelJobGroup("discovery-under-test")
        t.join(0.2)
        if not t.is_alive():
            break
    assert not t.is_alive() and seen and raised and "cancel" in raised[0].lower()


def test_weighted_orders_and_samples(spark):
    rows = [(g, i, w) for g in range(300) for i, w in enumerate((8.0, 1.0, 1.0, None, 0.0))]
    df = spark.createDataFrame(rows, "g long, i long, w double")
    got = {(r.g, r.i): r.place for r in sampling.weighted_order(df, "g", "i", "w", 3).collect()}
    assert got == {(r.g, r.i): r.place for r in sampling.weighted_order(df.repartition(7), "g", "i", "w", 3).collect()}
    assert all(sorted(got[g, i] for i in range(5)) == [1, 2, 3, 4, 5] for g in range(300))
    first = np.mean([got[g, 0] == 1 for g in range(300)])
    assert 0.7 < first < 0.9 and all(got[g, i] > 3 for g in range(300) for i in (3, 4))  # 8 of 10 to be first; no weight comes last
    some = {(r.g, r.i): r.place for r in sampling.weighted_sample(df, "g", "i", "w", 2, 3).collect()}
    assert some == {k: v for k, v in got.items() if v <= 2}


def test_durations_are_drawn_by_key(spark):
    rows = [(i, k, 100.0, 20.0, 0.0, None) for i in range(800) for k in sampling.DISTRIBUTIONS] + [(1, None, None, None, None, None), (2, "normal", 0.0, 5.0, 3.0, 9.0), (3, "NORMAL", 100.0, 50.0, 90.0, 95.0)]
    df = spark.createDataFrame(rows, "id long, dist_type string, mean_seconds double, std_seconds double, min_seconds double, max_seconds double")
    key = "id"
    got = sorted(map(tuple, sampling.sample_durations(df, key, 5).collect()), key=repr)
    assert got == sorted(map(tuple, sampling.sample_durations(df.repartition(9), key, 5).collect()), key=repr)
    assert got != sorted(map(tuple, sampling.sample_durations(df, key, 6).collect()), key=repr)
    of = lambda k: np.array([r[-1] for r in got if r[1] == k and r[2] == 100.0 and r[5] is None])
    assert set(of("fixed")) == {100.0} and abs(of("normal").mean() - 100) < 3 and abs(of("lognormal").mean() - 100) < 3 and abs(of("exponential").mean() - 100) < 15 and abs(of("lognormal").std() - 20) < 3
    odd = {r[0]: r[-1] for r in got if r[1] in (None, "NORMAL") or r[2] == 0.0}
    assert odd[1] > 0 and odd[2] == 3.0 and 90.0 <= odd[3] <= 95.0
