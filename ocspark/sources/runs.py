"""What runs leave behind: parameters and measures as JSON by section, a history of runs; and pages of a table for a reader."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "section string, columns string, row string"


def write_parameters(sections: dict[str, DataFrame], path: str) -> None:
    """Frames of any shape under one path: a line has its section, the section's columns and the row as JSON. NaN is written as null."""
    if not sections:
        raise ValueError("no parameters")
    out = None
    for name, df in sections.items():
        plain = df.select(*[F.nanvl(c, F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
        one = plain.select(F.lit(name).alias("section"), F.lit(plain.schema.json()).alias("columns"), F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = one if out is None else out.unionByName(one)
    out.write.mode("errorifexists").partitionBy("section").json(path)


def read_parameters(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The frames of write_parameters by section; a section without rows left no trace."""
    from pyspark.sql.types import StructType

    lines = spark.read.schema(SECTION).json(path)
    shapes = {r.section: r.columns for r in lines.groupBy("section").agg(F.min("columns").alias("columns")).collect()}  # a row a section
    return {name: lines.where(F.col("section") == name).select(F.from_json("row", StructType.fromJson(json.loads(shape))).alias("x")).select("x.*") for name, shape in shapes.items()}


def record(spark: SparkSession, path: str, run: str, at_us: int, entry: dict) -> None:
    """Adds a run to a history. Entries are files of their own, so runs may be recorded at one time."""
    spark.createDataFrame([(run, at_us, json.dumps(entry, sort_keys=True))], "run string, at_us long, entry string").coalesce(1).write.mode("append").json(path)


def history(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """run, at_us, entry of the latest runs, latest first; a run recorded again counts as of its last entry."""
    rows = spark.read.schema("run string, at_us long, entry string").json(path)
    last = rows.groupBy("run").agg(F.max(F.struct("at_us", "entry")).alias("x")).select("run", "x.at_us", "x.entry")
    return last.orderBy(F.desc("at_us"), F.desc("run")).limit(most)


def natural(column: str) -> list[Column]:
    """An order of texts: numbers first and as numbers, then the others, case aside, then as written; nulls last."""
    return [F.col(column).try_cast("double").asc_nulls_last(), F.lower(column).asc_nulls_last(), F.col(column).asc_nulls_last()]


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """The number-th page, from 1, of df in an order. Spark keeps the first number * size rows of each task only."""
    if number < 1 or size < 1:
        raise ValueError("pages are counted from 1 and hold a row at least")
    return df.orderBy(*order).limit(number * size).offset((number - 1) * size)
