"""Monitors of event streams: windowed counts with watermarks, and response obligations kept per object."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Events (activity, ts) of each activity in tumbling or sliding windows; later ones than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "activity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "activity", "n")


def sessions(events: DataFrame, gap: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Sessions of each object (oid, ts): runs of events with no gap of the given length.

    An event counts while its own window (its time and the gap) ends ahead of the watermark. A
    session is held for one more gap than its window, as until then an event that still counts can
    join it: Spark's session windows end with the window, and what comes then begins a second one.
    State holds the object's open sessions as three numbers each.
    """
    width, delay = (pd.Timedelta(x).value // 1000 for x in (gap, late))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(zip(*state.get, strict=True)) if state.exists else []
        runs: list[list[int]] = []
        for first, last, n in sorted([*open_, *((us, us, 1) for b in batches for us in b["us"].tolist())]):
            if runs and first - runs[-1][1] < width:
                runs[-1][1], runs[-1][2] = max(last, runs[-1][1]), runs[-1][2] + n
            else:
                runs.append([first, last, n])
        now = state.getCurrentWatermarkMs()
        done, open_ = [r for r in runs if r[1] + 2 * width <= now * 1000], [r for r in runs if r[1] + 2 * width > now * 1000]
        if open_:
            state.update(tuple(map(list, zip(*open_, strict=True))))
            state.setTimeoutTimestamp(max(-(-(open_[0][1] + 2 * width) // 1000), now + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([(key[0], first, last + width, n) for first, last, n in done], columns=["oid", "start", "end", "n"])

    rows = events.where("ts is not null").select("oid", F.unix_micros("ts").alias("us"), F.timestamp_micros(F.unix_micros("ts") + width).alias("until"))
    said = (
        rows.withWatermark("until", f"{delay + width} microseconds")  # of the windows' ends, so that it lies where that of the times would
        .groupBy("oid")
        .applyInPandasWithState(step, "oid string, start long, end long, n long", "firsts array<long>, lasts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )
    return said.select("oid", F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


def response_monitor(events: DataFrame, src: str, tgt: str, horizon: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Each src of an object must be followed by a strictly later tgt within the horizon: one row when that is so, or when it no longer can be.

    The verdict is by event times, however the events are cut into batches. State holds the
    object's open obligations alone; the horizon bounds it.
    """
    limit = pd.Timedelta(horizon)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_: list[int] = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            out += [(key[0], o, None, "violated") for o in open_ if o + limit.value // 1000 <= now]
            open_ = [o for o in open_ if o + limit.value // 1000 > now]
        else:
            rows = sorted((int(pd.Timestamp(t).value // 1000), a) for b in batches for t, a in zip(b["ts"], b["activity"], strict=True))
            for us, a in rows:
                if a == tgt:
                    out += [(key[0], o, us, "fulfilled") if us - o <= limit.value // 1000 else (key[0], o, None, "violated") for o in open_ if o < us]
                    open_ = [o for o in open_ if o >= us]
                if a == src:
                    open_.append(us)
        if open_:
            state.update((open_,))
            due = max(min(open_) // 1000 + limit.value // 1_000_000, state.getCurrentWatermarkMs() + 1)
            state.setTimeoutTimestamp(int(due))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["oid", "activation_us", "response_us", "verdict"]).astype({"response_us": "Int64"})

    return (
        events.withWatermark("ts", late)
        .groupBy("oid")
        .applyInPandasWithState(step, "oid string, activation_us long, response_us long, verdict string", "open array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )
