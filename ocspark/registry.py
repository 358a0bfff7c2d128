"""Registry of queries over the test tables and of the SQL that each is compared with.

An operator is a function (dialect, **parameters) that writes SQL over the relations of a
log. The decorator makes of it a function of an EventLog, and registers the query over one
of the projections, together with the same relations' SQL for the comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .log import RELATIONS, EventLog, ctes, project
from .plans.dialect import DUCK, SPARK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.])")


def doubles(text: str) -> str:
    """Decimal literals as doubles, so that both engines compute in the same type."""
    return _DECIMAL.sub(r"\1e0", text)


def duck_sql(text: str, kind: str, other: str | None = None) -> str:
    names = {r: r for r in RELATIONS}
    with_ = ctes(kind)
    if other:
        with_ += ", " + ctes(other, "z_")
        names |= {f"z_{r}": f"z_{r}" for r in RELATIONS}
    return f"with {with_} select * from ({text.format(**names)}) q"


def add(name: str, kind: str, write, other: str | None = None, **params) -> None:
    """Register write(dialect, **params) as a query over a projection (and a second log for comparisons)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = {}
        text = doubles(write(SPARK, **params))
        if other:
            z = project(spark, sf_dir, other)
            more = {f"z_{r}": getattr(z, r) for r in RELATIONS if "{z_" + r + "}" in text}
        return project(spark, sf_dir, kind).sql(text, **more)

    QUERIES[name] = query
    ORACLE[name] = duck_sql(doubles(write(DUCK, **params)), kind, other)


def operator(kind: str, name: str | None = None, **defaults):
    """Decorator: f(dialect, **params) becomes f(log, **params), and is registered over `kind` with `defaults`."""

    def wrap(write):
        add(name or write.__name__, kind, write, **defaults)

        @wraps(write)
        def run(log: EventLog, **params) -> DataFrame:
            return log.sql(doubles(write(SPARK, **{**defaults, **params})))

        run.write = write
        return run

    return wrap


def comparison(name: str, **defaults):
    """The same for f(log, other): relations of the other log are z_ev, z_eo, ..."""

    def wrap(write):
        add(name, "u_reference", write, other="u_simulated", **defaults)

        @wraps(write)
        def run(log: EventLog, other: EventLog, **params) -> DataFrame:
            text = doubles(write(SPARK, **{**defaults, **params}))
            return log.sql(text, **{f"z_{r}": getattr(other, r) for r in RELATIONS if "{z_" + r + "}" in text})

        return run

    return wrap
