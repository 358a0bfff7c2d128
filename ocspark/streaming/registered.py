"""Streams over the given events as queries: rows come in parts, some late, some too late; the SQL works on the rows that count."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registered_discovery import templates_sql
from ..registry import ORACLE, QUERIES
from ..storage import shared_dir
from . import monitors, state

PARTS = 4
DAYS = 8  # of the month that each part takes
LATE_DAYS = 2


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events with the part in which they arrive: that of their day, for one in 53 the next, for one in 59 the second after."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / DAYS), F.lit(PARTS - 1)) + F.when(F.col("event_id") % 53 == 0, 1).when(F.col("event_id") % 59 == 0, 2).otherwise(0)
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("oid"), F.col("event_id").cast("string").alias("eid"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), part.cast("int").alias("part"))


def replay(rows: DataFrame, make: Callable[[DataFrame], DataFrame], parts: int = PARTS + 2) -> DataFrame:
    """What a stream says of rows that arrive part by part; each part is a run from the checkpoint of the one before.

    A last row of no object, far ahead, moves the watermark past all others.
    """
    spark = rows.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    given = rows.drop("part")
    end = spark.range(1).select(F.lit("").alias("oid"), F.lit("").alias("eid"), F.lit("").alias("activity"), F.lit("2100-01-01 00:00:00").cast("timestamp").alias("ts"))
    out = None
    for k in range(parts + 1):
        (rows.where(F.col("part") == k).drop("part") if k < parts else end).write.mode("append").parquet(f"{at}/in")
        said = make(spark.readStream.schema(given.schema).parquet(f"{at}/in"))
        out = out or said.schema
        said.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{at}/out")


#: The rows that count: a part's rows later than the greatest time of the parts before, less the delay.
_KEPT = f"""e as (select *, least((day(ts) - 1) // {DAYS}, {PARTS - 1}) + case when event_id % 53 = 0 then 1 when event_id % 59 = 0 then 2 else 0 end as part from events),
  m as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) as mark from e group by part),
  kept as (select concat('user_', user_id) as oid, cast(event_id as varchar) as eid, event_type as activity, epoch_us(ts) as us from e join m using (part) where mark is null or ts > date_trunc('millisecond', mark) - interval {LATE_DAYS} day)"""


def _late() -> str:
    return f"{LATE_DAYS} days"


def stream_prefix_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each prefix template refuses, as the stream says."""
    said = replay(arrivals(spark, sf_dir), lambda s: state.prefix_monitor(s, "view", "purchase", late=_late())).where("oid <> ''")
    events = said.count()
    names = F.array(*[F.lit(k) for k in state.prefix_rules("", 1, 1)])
    each = said.select("refused", F.explode(names).alias("template")).groupBy("template")
    return each.agg(F.sum(F.array_contains("refused", F.col("template")).cast("long")).alias("refused"), F.lit(events).cast("long").alias("events"))


QUERIES["stream_prefix_templates"] = stream_prefix_templates
ORACLE["stream_prefix_templates"] = f"with {_KEPT} {templates_sql('kept')}"


def stream_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that ask for two purchases within five days; an error ends what is open."""
    horizon = 5 * 86_400_000_000
    return replay(arrivals(spark, sf_dir), lambda s: state.obligation_monitor(s, "click", "purchase", ("error",), 2, horizon, _late()))


QUERIES["stream_obligations"] = stream_obligations
ORACLE["stream_obligations"] = f"""with {_KEPT}, a as (select oid, eid, us, us + 5 * 86400000000 as due from kept where activity = 'click'),
  t as (select a.oid, a.eid, y.us as done, y.eid as y, row_number() over (partition by a.oid, a.eid order by y.us, y.eid) as k from a join kept y on y.oid = a.oid and y.activity = 'purchase' and y.us > a.us),
  f as (select oid, eid, done, y from t where k = 2),
  x as (select a.oid, a.eid, min((y.us, y.eid)) as stop from a join kept y on y.oid = a.oid and y.activity = 'error' and (y.us, y.eid) > (a.us, a.eid) group by a.oid, a.eid),
  v as (select a.*, f.done, case when f.done <= a.due and (x.stop is null or (f.done, f.y) < x.stop) then 'fulfilled' when x.stop is not null and x.stop[1] <= a.due then 'cancelled' else 'violated' end as verdict
    from a left join f on f.oid = a.oid and f.eid = a.eid left join x on x.oid = a.oid and x.eid = a.eid)
  select oid, us as activation_us, case when verdict = 'fulfilled' then done end as response_us, verdict from v"""


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each activity by the hour."""
    rows = replay(arrivals(spark, sf_dir), lambda s: monitors.windowed_counts(s, "1 hour", late=_late())).where("activity <> ''")
    return rows.select(F.unix_micros("start").alias("start_us"), "activity", "n")


QUERIES["stream_windows"] = stream_windows
# a late row still counts while the end of its window is ahead of the watermark
_OPEN = _KEPT.replace("ts > date_trunc('millisecond', mark)", "time_bucket(interval 1 hour, ts) + interval 1 hour > date_trunc('millisecond', mark)")
ORACLE["stream_windows"] = f"with {_OPEN} select us - us % 3600000000 as start_us, activity, count(*) as n from kept group by all"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: no gap of twelve hours."""
    rows = replay(arrivals(spark, sf_dir), lambda s: monitors.sessions(s, "12 hours", late=_late())).where("oid <> ''")
    return rows.select("oid", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES["stream_sessions"] = stream_sessions
_SESSION = _KEPT.replace("ts > date_trunc('millisecond', mark)", "ts + interval 12 hour > date_trunc('millisecond', mark)")
ORACLE["stream_sessions"] = f"""with {_SESSION}, g as (select oid, us, case when us - lag(us) over (partition by oid order by us) < 43200000000 then 0 else 1 end as new from kept),
  s as (select *, sum(new) over (partition by oid order by us rows unbounded preceding) as k from g)
  select oid, min(us) as start_us, max(us) + 43200000000 as end_us, count(*) as n from s group by oid, k"""
