"""Draws that depend on rows' keys and a seed alone, so they are the same under any layout and after any retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1] for each row, from a hash of the seed and the row's keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(1 << 52))


def _key(group: str, item: str, weight: str, seed: int, least: float) -> Column:
    return F.log(uniform(seed, group, item)) / F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(least))


def weighted_order(df: DataFrame, group: str, item: str, weight: str, seed: int = 0, least: float = 1e-9) -> DataFrame:
    """df with place, from 1: each group's rows drawn without replacement in proportion to their weights.

    The keys U ** (1 / weight), largest first, have that order; their logarithms are compared, which don't
    underflow. Weights that are null or not positive count as `least`. Equal keys go by item.
    A group is ordered within ranges of keys, even in their logarithm; the ranges' sizes, one row each, are carried on.
    """
    keyed = df.withColumn("__u", _key(group, item, weight, seed, least))
    keyed = keyed.withColumn("__cell", F.floor(F.log(F.greatest(-F.col("__u"), F.lit(1e-300))) * 20))
    sizes = keyed.groupBy(group, "__cell").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__cell")) - F.col("__n")).drop("__n")
    sizes = sizes.select(F.col(group).alias("__g"), F.col("__cell").alias("__c"), "__before")
    placed = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__cell").orderBy(F.desc("__u"), item)))
    placed = placed.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__cell") == F.col("__c")))
    return placed.withColumn("place", (F.col("__r") + F.col("__before")).cast("long")).select(*[c for c in df.columns if c != "place"], "place")


def weighted_sample(df: DataFrame, group: str, item: str, weight: str, most: int, seed: int = 0, least: float = 1e-9, cells: int = 64) -> DataFrame:
    """The first `most` rows of each group's weighted order. Hot groups are thinned in cells first, so no task orders a whole group."""
    keyed = df.withColumn("__u", _key(group, item, weight, seed, least)).withColumn("__cell", F.pmod(F.xxhash64(item), F.lit(cells)))
    first = lambda d, *by: d.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__u"), item))).where(F.col("__r") <= most)
    return first(first(keyed, group, "__cell"), group).withColumnRenamed("__r", "place").drop("__u", "__cell")


DISTRIBUTIONS = ("fixed", "exponential", "normal", "lognormal")


def draw(kind: str, mean: float, std: float, low: float, high: float, rng: np.random.Generator) -> float:
    """A duration in seconds, held between low and high."""
    if not mean > 0:
        return max(0.0, low)
    if kind == "fixed" or not std >= 1e-9:
        value = mean
    elif kind == "exponential":
        value = rng.exponential(mean)
    elif kind == "normal":
        value = rng.normal(mean, std)
    else:  # lognormal with that mean and deviation
        spread = math.log1p((std / mean) ** 2)
        value = rng.lognormal(math.log(mean) - spread / 2, math.sqrt(spread))
    return min(max(low, value), high)


def sample_durations(df: DataFrame, key: str, seed: int = 0, out: str = "duration_s") -> DataFrame:
    """df (dist_type, mean_seconds, std_seconds, min_seconds, max_seconds; null as lognormal, 3600, 600, 0, no bound) with a drawn duration.

    The generator of each row is seeded by the seed and the row's key: the value doesn't depend on batches, partitions or order.
    """

    @F.pandas_udf("double")
    def drawn(k: pd.Series, kind: pd.Series, mean: pd.Series, std: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        def one(x):
            digest = hashlib.blake2b(f"{seed}:{x[0]}".encode(), digest_size=16).digest()
            return draw(*x[1:], np.random.Generator(np.random.PCG64(int.from_bytes(digest, "little"))))

        return pd.Series([one(x) for x in zip(k, kind.str.lower(), mean, std, low, high, strict=True)], dtype=float)

    or_ = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return df.withColumn(out, drawn(F.coalesce(F.col(key).cast("string"), F.lit("")), or_("dist_type", "lognormal"), or_("mean_seconds", 3600.0), or_("std_seconds", 600.0), or_("min_seconds", 0.0), or_("max_seconds", math.inf)))
