"""Two logs compared in one call: sections of measures, each ok or unavailable with a reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..log import RELATIONS, EventLog
from ..storage import save
from . import arcs as arc_sql
from . import measures
from ..registry import doubles
from ..plans.dialect import SPARK
from .arcs import Arc

WASSERSTEIN = ("n_reference", "n_simulated", "w1")
#: Section, the measure's frame, what it is measured of ('' for the whole log), the measured columns.
SECTIONS: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("kl.activities", "kl_activity", "", ("kl_forward", "kl_backward")),
    ("kl.objects", "kl_objects", "", ("kl_forward", "kl_backward")),
    ("timing.wmape", "wmape", "", ("wmape_mean", "wmape_std")),
    ("timing.wasserstein", "wasserstein", "activity", WASSERSTEIN),
    ("ngd.2", "ngd_2", "otype", ("ngd",)),
    ("ngd.3", "ngd_3", "otype", ("ngd",)),
]


def _measured(log: EventLog, other: EventLog, name: str) -> DataFrame:
    if name.startswith("ngd_"):
        text = doubles(measures.ngd(SPARK, int(name[-1])))
        return log.sql(text, **{f"z_{r}": getattr(other, r) for r in RELATIONS if "{z_" + r + "}" in text})
    return getattr(measures, name)(log, other)


def tall(frame: DataFrame, section: str, of: str, columns: tuple[str, ...]) -> DataFrame:
    """section, item, measure, value of a frame of measures."""
    columns = columns or tuple(c for c, t in frame.dtypes if c != of and t != "string")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]))
    item = F.col(of) if of else F.lit("")
    return frame.select(F.lit(section).alias("section"), item.alias("item"), pairs.alias("x")).select("section", "item", "x.measure", "x.value")


def evaluate_logs(log: EventLog, other: EventLog | None, model: list[Arc] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(section, item, measure, value) of all sections, and of each section 'ok' or why it is unavailable.

    Conformance is of both logs to the model, the rest compares them. A measure that is not a
    number is null. Each section is run and stored by itself, so a failure, in planning or at run time, leaves the others be.
    """
    status: dict[str, str] = {}
    out: list[DataFrame] = []

    def attempt(section: str, make: Callable[[], DataFrame]) -> None:
        try:
            out.append(save(make(), section))
            status[section] = "ok"
        except (ValueError, KeyError, TypeError, NotImplementedError, PySparkException) as why:
            status[section] = str(why).partition("\n")[0]

    roles = {"input": log} if other is None else {"input": log, "simulated": other}
    for role, one in roles.items():
        attempt(f"logs.{role}", lambda one=one, role=role: one.sql(f"select 'logs.{role}' as section, '' as item, 'events' as measure, cast(count(*) as double) as value from {{ev}} union all select 'logs.{role}', '', 'objects', cast(count(*) as double) from {{ob}}"))

        def conformance(one=one, role=role) -> DataFrame:
            if not model:
                raise ValueError("no model")
            table = one.sql(doubles(arc_sql.confidence_sql(SPARK, model))).withColumn("item", F.col("cid").cast("string"))
            each = tall(table.select("item", "confidence", "activations", "violated"), f"conformance.{role}", "item", ())
            whole = tall(one.sql(doubles(arc_sql.global_confidence_sql(SPARK, model))), f"conformance.{role}", "", ("global_confidence",))
            cover = one.sql(doubles(arc_sql.coverage_sql(SPARK, model))).select(F.lit(f"conformance.{role}").alias("section"), F.lit("").alias("item"), F.concat(F.lit("coverage_"), "score").alias("measure"), F.col("value").cast("double").alias("value"))
            return each.union(whole).union(cover)

        attempt(f"conformance.{role}", conformance)
    for section, name, of, columns in SECTIONS:
        if other is None:
            status[section] = "no log to compare with"
            continue
        attempt(section, lambda section=section, name=name, of=of, columns=columns: tall(_measured(log, other, name), section, of, columns))
    result = out[0] if out else log.ev.sparkSession.createDataFrame([], "section string, item string, measure string, value double")
    for frame in out[1:]:
        result = result.union(frame)
    return result.withColumn("value", F.nanvl("value", F.lit(None).cast("double"))), status
