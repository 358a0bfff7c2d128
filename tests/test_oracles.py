"""Operators against plain Python over small random logs, written from the definitions."""

import random

import pytest

from ocspark.log import EventLog
from ocspark.operators import arcs, measures, params
from ocspark.plans import cuts

HOUR = 3_600_000_000


def make(spark, rng, n=120):
    events = [(f"e{i:03}", rng.choice("ABCD"), rng.choice([rng.randrange(40) * HOUR, rng.randrange(40 * HOUR)])) for i in range(n)]
    links = sorted({(e, f"{t}{rng.randrange(7)}", t) for e, _, _ in events for t in "uv" for _ in range(rng.randint(0, 2))})
    log = EventLog(
        spark.createDataFrame(events, "eid string, activity string, us long"), spark.createDataFrame(sorted({(o, t) for _, o, t in links}), "oid string, otype string"),
        spark.createDataFrame(links, "eid string, oid string, otype string"), spark.createDataFrame([], "src string, dst string, qualifier string"),
    )
    by = {e: (us, e, a) for e, a, us in events}
    traces = {}
    for e, o, t in links:
        traces.setdefault((t, o), []).append(by[e])
    return log, events, {k: sorted(v) for k, v in traces.items()}


@pytest.mark.parametrize("seed", range(2))
def test_trace_templates(spark, seed):
    log, _, traces = make(spark, random.Random(seed), 40)
    want = {}

    def check(name, checked, violated):
        c, v = want.get(name, (0, 0))
        want[name] = (c + bool(checked), v + bool(checked and violated))

    for (t, _), rows in traces.items():
        if t != "u":
            continue
        x = [a for _, _, a in rows]
        s, g = "A" in x, "B" in x
        check("response", s, s and "B" not in x[x.index("A") + 1 :])
        check("responded_existence", s, not g)
        check("precedence", g, g and "A" not in x[: x.index("B")])
        check("not_coexistence", True, s and g)
        check("not_succession", s, g)
        check("coexistence", s or g, not (s and g))
        check("exclusive_choice", True, s == g)
        check("existence", True, not s)
        check("absence", True, x.count("A") > 2)
        check("exactly", True, x.count("A") != 1)
        check("chain_response", s, False)
    got = {r.template: (r.checked, r.violated) for r in arcs.trace_templates(log, src="A", tgt="B", otype="u", nmin=1, nmax=2).collect()}
    assert got == want


def test_prefix_templates(spark):
    log, _, traces = make(spark, random.Random(5))
    want = dict.fromkeys("precedence response_cap chain_precedence chain_response not_coexistence not_succession not_chain_succession absence exactly init exclusive_choice alternate_response alternate_precedence not_precedence succession chain_succession alternate_succession".split(), 0)
    for (t, _), rows in traces.items():
        if t != "u":
            continue
        ns = nt = 0
        prev = None
        for _, _, a in rows:
            s, g = a == "A", a == "B"
            faults = {
                "precedence": g and ns < 1, "response_cap": g and nt >= 3, "chain_precedence": g and prev != "A", "chain_response": prev == "A" and not g, "not_coexistence": g and ns > 0 or s and nt > 0,
                "not_succession": g and ns > 0, "not_chain_succession": g and prev == "A", "absence": s and ns >= 3, "exactly": s and ns >= 1, "init": not g and nt == 0,
                "exclusive_choice": s and nt > 0 or g and ns > 0, "alternate_response": s and ns > nt, "alternate_precedence": g and nt >= ns,
            }
            faults |= {"not_precedence": g and ns > 0, "succession": g and (ns < 1 or nt >= 3), "chain_succession": faults["chain_precedence"] or faults["chain_response"], "alternate_succession": faults["alternate_response"] or faults["alternate_precedence"]}
            for k, bad in faults.items():
                want[k] += bad
            ns, nt, prev = ns + s, nt + g, a
    assert {r.template: r.refused for r in arcs.prefix_templates(log, src="A", tgt="B", otype="u", nmin=1, nmax=3).collect()} == want


def test_cut_windows(spark):
    """Gaps, running totals and peaks are those of one sort of everything."""
    rng = random.Random(3)
    log, events, traces = make(spark, rng)
    want = {}
    for a in "ABCD":
        at = sorted(us for _, x, us in events if x == a)
        want[a] = sorted(y - x for x, y in zip(at, at[1:], strict=False))
    got = {}
    for r in log.sql(f"select * from {cuts.gaps('activity', '{ev}')} g").collect():
        got.setdefault(r.activity, []).append(r.gap)
    assert {k: sorted(v) for k, v in got.items()} == want
    values = sorted({(k, rng.choice([0.0, rng.random() * 10, rng.random() * 1e6])) for k in "ab" for _ in range(60)})
    rows = [(k, v, rng.randint(0, 3), rng.randint(0, 3)) for k, v in values]
    spark.createDataFrame(rows, "activity string, v double, x long, y long").createOrReplaceTempView("cut_rows")
    got = {(r.activity, r.v): (r.c_x, r.c_y, r.n_x, r.n_y, r.nv) for r in spark.sql(f"select * from {cuts.cumulated('activity', 'cut_rows', 'x', 'y')} c").collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            assert got[k, r[1]] == (*(sum(z[c] for z in own[: i + 1]) for c in (2, 3)), *(sum(z[c] for z in own) for c in (2, 3)), own[i + 1][1] if i + 1 < len(own) else None)
    spans = {}
    for (t, _), x in traces.items():
        spans.setdefault(t, []).append((x[0][0], x[-1][0]))
    peaks = {t: max(sum(a <= p < b for a, b in own) for p, _ in own) for t, own in spans.items()}
    assert {r.otype: r.peak for r in params.wip_peak(log).collect()} == {t: n for t, n in peaks.items() if n}


def test_distances(spark):
    """W1 by areas between sorted samples, KS by counting, of gaps between neighbours on an object."""
    rng = random.Random(8)
    one, two = make(spark, rng), make(spark, rng)

    def hours(traces):
        out = {}
        for rows in traces.values():
            for x, y in zip(rows, rows[1:], strict=False):
                out.setdefault(x[2], []).append((y[0] - x[0]) / 1e6 / 3600.0)
        return out

    p, q = hours(one[2]), hours(two[2])
    got = {r.activity: (r.n_reference, r.n_simulated, r.w1) for r in measures.wasserstein(one[0], two[0]).collect()}
    for a in set(p) & set(q):
        cut = sorted(set(p[a]) | set(q[a]))
        share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
        w1 = sum(abs(share(p[a], x) - share(q[a], x)) * (y - x) for x, y in zip(cut, cut[1:], strict=False))
        assert got[a][:2] == (len(p[a]), len(q[a])) and abs(got[a][2] - w1) < 1e-5
    assert set(got) == set(p) & set(q)
