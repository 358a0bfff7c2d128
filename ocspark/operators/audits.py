"""Audits of a log against a model, cases of start activities, statistics over runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..log import EventLog
from .arcs import Arc


def _closed(closes: dict[str, str], otype: str = "otype", last: str = "last") -> Column:
    out = F.lit(False)
    for t, activity in closes.items():
        out = out | ((F.col(otype) == t) & (F.col(last) == activity))
    return out


def _lives(log: EventLog) -> DataFrame:
    """oid, otype, first_eid, first, last (activities), first_us, last_us, n of each object with events."""
    order = F.struct("us", "eid")
    return log.eo.groupBy("oid", "otype").agg(
        F.min_by("eid", order).alias("first_eid"), F.min_by("activity", order).alias("first"), F.max_by("activity", order).alias("last"),
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"),
    )


def lifecycle_classes(log: EventLog, closes: dict[str, str], model_types: tuple[str, ...] = ()) -> DataFrame:
    """Each type's instances, closed and unused ones, events an instance, and its class.

    closes: the activity that closes an object of a type if it is its last event. Classes, the
    first that holds: under_created (a type of the model without instances), orphaned,
    partially_orphaned, accumulating (several, all still open), healthy.
    """
    each = log.ob.select("oid", "otype").distinct().join(_lives(log).select("oid", "last", "n"), "oid", "left")
    found = each.groupBy("otype").agg(
        F.count("*").alias("instances"), F.count_if(_closed(closes)).alias("closed"), F.count_if(F.col("n").isNull()).alias("unused"),
        F.min(F.coalesce("n", F.lit(0))).alias("min_events"), F.round(F.sum(F.coalesce("n", F.lit(0))) / F.count("*"), 2).alias("mean_events"), F.max(F.coalesce("n", F.lit(0))).alias("max_events"),
    )
    model = log.ob.sparkSession.createDataFrame([(t,) for t in model_types], "otype string")
    all_ = found.join(model, "otype", "full").na.fill(0)
    verdict = (
        F.when(F.col("instances") == 0, "under_created").when(F.col("unused") == F.col("instances"), "orphaned").when(F.col("unused") > 0, "partially_orphaned")
        .when((F.col("closed") == 0) & (F.col("instances") > 1), "accumulating").otherwise("healthy")
    )
    return all_.withColumn("verdict", verdict)


def participation_classes(log: EventLog, model_activities: tuple[str, ...] = ()) -> DataFrame:
    """Each activity's firings, objects, objects a firing, share of firings that use an object again, the commonest object's share, class.

    Classes, the first that holds: never_fired, object_starved (one object in over 3 firings,
    or one in over 80 % of over 5), high_reuse (over 90 % of over 5 firings), healthy.
    """
    links = log.eo.select("activity", "eid", "oid", "us")
    met = links.groupBy("activity", "oid").agg(F.count("*").alias("n"), F.min(F.struct("us", "eid")).alias("first"))
    again = (F.col("first.eid") != F.col("eid")).cast("int")
    attached = links.join(met.select("activity", "oid", "first"), ["activity", "oid"]).groupBy("activity", "eid").agg(F.count("*").alias("k"), F.max(again).alias("again"))
    firings = log.ev.select("activity", "eid").join(attached, ["activity", "eid"], "left").na.fill(0, ["k", "again"])
    per = firings.groupBy("activity").agg(F.count("*").alias("firings"), F.min("k").alias("min_k"), F.round(F.avg("k"), 2).alias("mean_k"), F.max("k").alias("max_k"), F.sum("again").alias("again"))
    tops = met.groupBy("activity").agg(F.count("*").alias("objects"), F.max("n").alias("top"))
    model = log.ev.sparkSession.createDataFrame([(a,) for a in model_activities], "activity string")
    x = per.join(tops, "activity", "left").join(model, "activity", "full").na.fill(0)
    n, reuse = F.col("firings"), F.when(F.col("firings") > 1, F.round(F.col("again") / F.col("firings"), 3)).when(F.col("firings") == 1, 0.0)
    share = F.when(n > 0, F.round(100.0 * F.col("top") / n, 1))
    x = x.withColumn("reuse_rate", reuse).withColumn("top_pct", share)
    verdict = (
        F.when(n == 0, "never_fired").when((F.col("objects") == 1) & (n > 3), "object_starved").when((F.col("top") > 0.8 * n) & (n > 5), "object_starved")
        .when((F.col("reuse_rate") > 0.9) & (n > 5), "high_reuse").otherwise("healthy")
    )
    return x.select("activity", "firings", "objects", "min_k", "mean_k", "max_k", "reuse_rate", "top_pct", verdict.alias("verdict"))


@dataclass(frozen=True)
class Needs:
    """What a model says of an activity: types that it takes, types that it creates, activities that must come before."""

    takes: tuple[str, ...] = ()
    creates: tuple[str, ...] = ()
    after: tuple[str, ...] = field(default=())


def never_fired(log: EventLog, model: dict[str, Needs], transitions: DataFrame | None = None) -> DataFrame:
    """activity, reason, what: why an activity of the model is not in the log.

    Reasons: type_never_created, creator_never_fired, no_object_at_hand (what: the type),
    not_preceded (what: the activity missing before); by the pairs (a, b) of a transition
    matrix no_transition (into it at all), unlikely (none from an activity that fired);
    unknown if there is no other. Facts are the log's activities and types; a model is small.
    """
    spark = log.ev.sparkSession
    fired = log.ev.select("activity").distinct()
    absent = spark.createDataFrame([(a,) for a in model], "activity string").join(fired, "activity", "left_anti")
    creator: dict[str, str] = {}
    for a, needs in model.items():
        for t in needs.creates:
            creator.setdefault(t, a)
    takes = spark.createDataFrame([(a, t, creator.get(t)) for a, x in model.items() for t in x.takes], "activity string, what string, creator string")
    after = spark.createDataFrame([(a, b) for a, x in model.items() for b in x.after], "activity string, what string")
    types = log.ob.select(F.col("otype").alias("what")).distinct()
    known = fired.select(F.col("activity").alias("creator"), F.lit(True).alias("did"))
    lost = takes.join(types, "what", "left_anti").join(known, "creator", "left")
    why = F.when(F.col("creator").isNull(), "type_never_created").when(F.col("did"), "no_object_at_hand").otherwise("creator_never_fired")
    reasons = lost.select("activity", why.alias("reason"), "what")
    reasons = reasons.union(after.join(fired.select(F.col("activity").alias("what")), "what", "left_anti").select("activity", F.lit("not_preceded"), "what"))
    if transitions is not None:
        into = transitions.join(fired, transitions.a == fired.activity, "left").groupBy("b").agg(F.count("activity").alias("from_fired"))
        reached = absent.join(into, absent.activity == into.b, "left").where("b is null or from_fired = 0")
        reasons = reasons.union(reached.select("activity", F.when(F.col("b").isNull(), "no_transition").otherwise("unlikely"), F.lit(None).cast("string")))
    return absent.join(reasons, "activity", "left").select("activity", F.coalesce("reason", F.lit("unknown")).alias("reason"), "what")


def cases(log: EventLog, starts: tuple[str, ...], closes: dict[str, str], resources: tuple[str, ...] = ()) -> DataFrame:
    """start, eid, created, completed, duration_s of each firing of a start activity.

    Created are the objects of other than resource types whose first event it is; a case is
    completed if it created some and all are closed, and ends with their last event.
    """
    born = _lives(log).where(~F.col("otype").isin(*resources)) if resources else _lives(log)
    born = born.where(F.col("first").isin(*starts)).groupBy(F.col("first_eid").alias("eid")).agg(F.count("*").alias("created"), F.min(_closed(closes).cast("int")).alias("done"), F.max("last_us").alias("end_us"))
    x = log.ev.where(F.col("activity").isin(*starts)).join(born, "eid", "left")
    span = (F.col("end_us") - F.col("us")) / 1e6
    return x.select(F.col("activity").alias("start"), "eid", F.coalesce("created", F.lit(0)).alias("created"), (F.coalesce("done", F.lit(0)) == 1).alias("completed"), F.when(span >= 0, span).alias("duration_s"))


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, median of value, nulls left out: the middle values are found by counts, no task sorts a key's rows.

    Values are counted by ranges that are even in their logarithm; running totals of the
    ranges say in which the middle ranks are, and only the rows of these are numbered.
    """
    v = values.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"))
    v = v.withColumn("part", F.floor(F.log1p(F.abs("v")) * 200) * F.signum("v"))
    sizes = v.groupBy(key, "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("part")
    places = sizes.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    middle = lambda c: (F.col("before") < c) & (F.col("before") + F.col("n") >= c)
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    near = places.where(middle(lo) | middle(hi)).select(key, "part", "before", lo.alias("lo"), hi.alias("hi"))
    counts = v.join(near, [key, "part"]).groupBy(key, "part", "before", "lo", "hi", "v").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "part").orderBy("v"))
    picked = counts.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("n"))
    holds = lambda c: (F.col("since") < F.col(c)) & (F.col("upto") >= F.col(c))
    return picked.groupBy(key).agg(((F.max(F.when(holds("lo"), F.col("v"))) + F.max(F.when(holds("hi"), F.col("v")))) / 2).alias("median"))


def case_statistics(log: EventLog, starts: tuple[str, ...], closes: dict[str, str], resources: tuple[str, ...] = ()) -> DataFrame:
    """For each start activity its cases, how many are completed, and their durations."""
    each = cases(log, starts, closes, resources)
    one = lambda f: F.round(f("duration_s"), 1)
    out = each.groupBy("start").agg(
        F.count("*").alias("n_cases"), F.count_if("completed").alias("n_completed"), F.round(F.count_if("completed") / F.count("*"), 3).alias("completion_rate"),
        one(F.avg).alias("mean_s"), one(F.min).alias("min_s"), one(F.max).alias("max_s"),
    )
    return out.join(medians(each, "start", "duration_s").select("start", F.round("median", 1).alias("median_s")), "start", "left")


def run_statistics(values: DataFrame) -> DataFrame:
    """(run, measure, value) to measure, n, mean, std (of the population), min, max over the runs."""
    return values.where("value is not null").groupBy("measure").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_pop("value"), 2).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def run_values(log: EventLog, run: Column, arcs: list[Arc]) -> DataFrame:
    """(run, measure, value) of a log whose events belong to runs: events, objects, and of each arc the share of bindings that hold it."""
    from .arcs import bindings

    ev = log.ev.withColumn("run", run)
    counts = ev.groupBy("run").agg(F.count("*").cast("double").alias("value")).select("run", F.lit("events").alias("measure"), "value")
    objects = log.e2o.join(ev.select("eid", "run"), "eid").groupBy("run").agg(F.count_distinct("oid").cast("double").alias("value"))
    out = counts.union(objects.select("run", F.lit("objects"), "value"))
    for i, a in enumerate(arcs):
        ok = (F.col("n") >= a.nmin) & (F.lit(True) if a.nmax is None else F.col("n") <= a.nmax)
        rate = bindings(log, a).join(ev.select("eid", "run"), "eid").groupBy("run").agg((F.count_if(ok) / F.count("*")).alias("value"))
        out = out.union(rate.select("run", F.lit(f"arc_{i}"), "value"))
    return out


def lifecycle_from_arcs(arcs: DataFrame) -> DataFrame:
    """otype, activity, role of arcs (src, tgt, arc, types array): a type's entries are activities that its arcs only leave, its exits those that they only reach.

    EP and DP arcs point back in time; an AS arc leaves and reaches both its ends.
    """
    back, both = F.col("arc").isin("EP", "DP"), F.col("arc") == "AS"
    ends = F.array(F.struct(F.col("src").alias("activity"), (~back | both).alias("leaves"), (back | both).alias("reached")), F.struct(F.col("tgt").alias("activity"), (back | both).alias("leaves"), (~back | both).alias("reached")))
    each = arcs.select(F.explode("types").alias("otype"), ends.alias("ends")).select("otype", F.explode("ends").alias("e")).select("otype", "e.*")
    told = each.groupBy("otype", "activity").agg(F.max("leaves").alias("leaves"), F.max("reached").alias("reached")).where("leaves <> reached")
    return told.select("otype", "activity", F.when(F.col("leaves"), "creates").otherwise("deactivates").alias("role"))
