"""Stateful monitors of objects: events are put in order behind the watermark, then each moves its object's state.

Events reach a stream late and in any order. Each waits in a map state under its time and name until
the watermark has passed it; an event-time timer then hands what waits to the monitor in the
order (us, eid), so results are those of the whole log in order, however it was
cut into batches. Rows that come later than the watermark allows are dropped by the stream.
State is an object's own: what waits, and one value of fixed size or of its open obligations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Events (us, eid, activity) of an object in order. Subclasses give `memo`, the schema of their state, and the three methods below."""

    memo: str

    def fresh(self) -> tuple:
        """The state of an object not seen yet."""
        raise NotImplementedError

    def step(self, oid: str, memo: tuple, us: int, eid: str, activity: str) -> tuple[tuple, list[Row]]:
        """The state after one event, and what is to be said of it."""
        raise NotImplementedError

    def pause(self, oid: str, memo: tuple, now: int) -> tuple[tuple | None, list[Row], int | None]:
        """All events up to now (us) are in: the state (None: forget the object), what is to be said, and when to look again without an event."""
        return memo, [], None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, eid string", "activity string")
        self.kept = handle.getValueState("memo", self.memo)

    def _call_at(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r.us, r.eid), (r.activity,))
            first = r.us if first is None else min(first, r.us)
        if first is not None:
            self._call_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator())
        ready = [x for x in held if x[0] <= now]
        memo = tuple(self.kept.get()) if self.kept.exists() else self.fresh()
        said: list[Row] = []
        for us, eid, activity in ready:
            memo, more = self.step(key[0], memo, us, eid, activity)
            said += more
            self.waiting.removeKey((us, eid))
        memo, more, again = self.pause(key[0], memo, now)
        said += more
        if memo is None:
            self.kept.clear()
        else:
            self.kept.update(memo)
        if len(held) > len(ready):
            self._call_at(held[len(ready)][0])
        if again is not None:
            self._call_at(again)
        return iter(said)

    def close(self) -> None:
        pass


def monitored(events: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    """A monitor over a stream of (oid, eid, activity, ts); needs the state store that keeps timers, which it asks the session for."""
    events.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.select("oid", "eid", "activity", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return rows.groupBy("oid").transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


Rule = Callable[[bool, bool, int, int, str | None], bool]


def prefix_rules(src: str, nmin: int, nmax: int) -> dict[str, Rule]:
    """When an eager monitor of a template refuses an event: is it src, is it tgt, how many of each came before, which activity came last."""
    return {
        "precedence": lambda s, t, ns, nt, last: t and ns < nmin,
        "response_cap": lambda s, t, ns, nt, last: t and nt >= nmax,
        "chain_precedence": lambda s, t, ns, nt, last: t and last != src,
        "chain_response": lambda s, t, ns, nt, last: last == src and not t,
        "not_coexistence": lambda s, t, ns, nt, last: (t and ns > 0) or (s and nt > 0),
        "not_succession": lambda s, t, ns, nt, last: t and ns > 0,
        "not_chain_succession": lambda s, t, ns, nt, last: t and last == src,
        "absence": lambda s, t, ns, nt, last: s and ns >= nmax,
        "exactly": lambda s, t, ns, nt, last: s and ns >= nmin,
        "init": lambda s, t, ns, nt, last: not t and nt == 0,
        "exclusive_choice": lambda s, t, ns, nt, last: (s and nt > 0) or (t and ns > 0),
        "alternate_response": lambda s, t, ns, nt, last: s and ns > nt,
        "alternate_precedence": lambda s, t, ns, nt, last: t and nt >= ns,
        "not_precedence": lambda s, t, ns, nt, last: t and ns > 0,
        "succession": lambda s, t, ns, nt, last: t and (ns < nmin or nt >= nmax),
        "chain_succession": lambda s, t, ns, nt, last: (t and last != src) or (last == src and not t),
        "alternate_succession": lambda s, t, ns, nt, last: (s and ns > nt) or (t and nt >= ns),
    }


class PrefixTemplates(InOrder):
    """Of each event the templates that refuse it. idle_us: an object without events for so long is as if new."""

    memo = "ns long, nt long, last string, seen long"

    def __init__(self, src: str, tgt: str, nmin: int = 1, nmax: int = 10, idle_us: int | None = None) -> None:
        self.src, self.tgt, self.nmin, self.nmax, self.idle = src, tgt, nmin, nmax, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.rules = prefix_rules(self.src, self.nmin, self.nmax)

    def fresh(self) -> tuple:
        return 0, 0, None, None

    def step(self, oid, memo, us, eid, activity):
        if self.idle is not None and memo[3] is not None and us - memo[3] > self.idle:
            memo = self.fresh()
        ns, nt, last, _ = memo
        s, t = activity == self.src, activity == self.tgt
        refused = [k for k, rule in self.rules.items() if rule(s, t, ns, nt, last)]
        return (ns + s, nt + t, activity, us), [Row(oid=oid, eid=eid, us=us, activity=activity, refused=refused)]

    def pause(self, oid, memo, now):
        if self.idle is None or memo[3] is None:
            return memo, [], None
        gone = memo[3] + self.idle + 1
        return (None, [], None) if gone <= now else (memo, [], gone)


def prefix_monitor(events: DataFrame, src: str, tgt: str, nmin: int = 1, nmax: int = 10, late: str = "2 days", idle_us: int | None = None) -> DataFrame:
    """oid, eid, us, activity, refused: which prefix templates refuse each event of an object, by what came before."""
    return monitored(events, PrefixTemplates(src, tgt, nmin, nmax, idle_us), "oid string, eid string, us long, activity string, refused array<string>", late)


class Obligations(InOrder):
    """Responses that are due: each src asks for nmin strictly later tgt within the horizon; an end of the object cancels what is open."""

    memo = "open array<struct<us:long,left:long>>"

    def __init__(self, src: str, tgt: str, ends: tuple[str, ...] = (), nmin: int = 1, horizon_us: int = 86_400_000_000) -> None:
        self.src, self.tgt, self.ends, self.nmin, self.horizon = src, tgt, ends, nmin, horizon_us

    def fresh(self) -> tuple:
        return ([],)

    def _expired(self, oid, open_, before: int) -> tuple[list, list[Row]]:
        gone = [Row(oid=oid, activation_us=us, response_us=None, verdict="violated") for us, _ in open_ if us + self.horizon < before]
        return [(us, left) for us, left in open_ if us + self.horizon >= before], gone

    def step(self, oid, memo, us, eid, activity):
        open_, said = self._expired(oid, [tuple(x) for x in memo[0]], us)
        if activity == self.tgt:
            open_ = [(at, left - (at < us)) for at, left in open_]
            said += [Row(oid=oid, activation_us=at, response_us=us, verdict="fulfilled") for at, left in open_ if left == 0]
            open_ = [x for x in open_ if x[1]]
        if activity in self.ends:
            said += [Row(oid=oid, activation_us=at, response_us=None, verdict="cancelled") for at, _ in open_]
            open_ = []
        elif activity == self.src:
            open_.append((us, self.nmin))
        return (open_,), said

    def pause(self, oid, memo, now):
        open_, said = self._expired(oid, [tuple(x) for x in memo[0]], now + 1)
        if not open_:
            return None, said, None
        return (open_,), said, min(us for us, _ in open_) + self.horizon + 1


def obligation_monitor(events: DataFrame, src: str, tgt: str, ends: tuple[str, ...] = (), nmin: int = 1, horizon_us: int = 86_400_000_000, late: str = "2 days") -> DataFrame:
    """oid, activation_us, response_us, verdict: a row for each src once it is known whether nmin tgt follow in time, or an end cancels it."""
    return monitored(events, Obligations(src, tgt, ends, nmin, horizon_us), "oid string, activation_us long, response_us long, verdict string", late)
