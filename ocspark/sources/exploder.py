"""A table function that takes event logs, held one a row as JSON texts, apart."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="eid string, activity string, time string, oid string, otype string")
class LogEvents:
    """A row for each event and object of a log in version 2, or one with a null object; nothing for other texts."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            log = json.loads(text or "")
        except ValueError:
            return
        if not isinstance(log, dict):
            return
        types = {o.get("id"): o.get("type") for o in log.get("objects") or []}
        for e in log.get("events") or []:
            links = sorted({r.get("objectId") for r in e.get("relationships") or []} - {None})
            for oid in links or [None]:
                yield e.get("id"), e.get("type"), e.get("time"), oid, types.get(oid)


def exploded(texts: DataFrame, column: str) -> DataFrame:
    """Events of the logs in a column of texts; rows spread as the table's do."""
    text = texts.select(F.col(column).alias("text"))
    return text.lateralJoin(LogEvents(F.col("text").outer())).drop("text")
