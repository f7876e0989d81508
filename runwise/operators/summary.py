"""Summaries of the costed landings (one aggregation pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwise.constants import SAMPLE_CAP
from runwise.operators.costs import MEASURES

MEAN_MEASURES = MEASURES[:19]


def summarise(df: DataFrame) -> DataFrame:
    """A2: the 19 means in one row (one pass instead of one job per mean)."""
    return df.agg(*[F.avg(c).alias(c) for c in MEAN_MEASURES])


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A3: count, mean, stddev (sample), min, max of each measure; one aggregation, five rows."""
    cols = cols or MEASURES
    stats = [("count", lambda c: F.count(c).cast("double")), ("mean", F.avg), ("stddev", F.stddev_samp),
             ("min", F.min), ("max", F.max)]
    one = df.agg(*[fn(c).alias(f"{s}__{c}") for s, fn in stats for c in cols])
    rows = F.array(*[F.struct(F.lit(s).alias("summary"), *[F.col(f"{s}__{c}").cast("double").alias(c) for c in cols])
                     for s, _ in stats])
    return one.select(F.inline(rows))


def distinct_counts(df: DataFrame) -> DataFrame:
    """A5: distinct runways and exits."""
    return df.agg(F.countDistinct("runway").alias("num_runways"), F.countDistinct("exit").alias("num_exits"))


def _unpivot(means: DataFrame, items: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(label).alias("item"), F.col(opt).alias("optimal"), F.col(act).alias("predicted"),
                              (F.col(act) - F.col(opt)).alias("difference")) for label, opt, act in items])
    return means.select(F.inline(rows))


def impact_societal(df: DataFrame) -> DataFrame:
    """A10: passenger and environmental cost, mean predicted - mean optimal."""
    return _unpivot(summarise(df), [("passenger", "optPcost", "actualPcost"),
                                    ("environmental", "optEnvCost", "actualEnvCost")])


def impact_airline(df: DataFrame) -> DataFrame:
    """Airline costs and the ROT benefit (mean savings)."""
    m = summarise(df)
    items = _unpivot(m, [("fuel", "optFuelCost", "actualFuelCost"), ("crew", "optCrewCost", "actualCrewCost"),
                         ("maintenance", "optMaintCost", "actualMaintCost"), ("ownership", "optAOCost", "actualAOCost"),
                         ("other", "optOtherCost", "actualOtherCost")])
    benefit = m.select(F.lit("rot_benefit").alias("item"), F.lit(0.0).alias("optimal"),
                       F.col("savings").alias("predicted"), F.col("savings").alias("difference"))
    return items.unionByName(benefit)


def time_reduction(df: DataFrame) -> DataFrame:
    """Mean predicted vs optimal ROT and taxi time."""
    return _unpivot(summarise(df), [("rot", "optROT", "actualROT"), ("taxi", "optTT", "actualTT")])


def top_sample(df: DataFrame, n: int = SAMPLE_CAP, key: str = "flight_id") -> DataFrame:
    """L1: a deterministic sample of at most ``n`` rows (smallest MD5 of the key); top-k, no global sort."""
    return df.withColumn("_h", F.md5(F.col(key).cast("string"))).orderBy("_h", key).limit(n).drop("_h")
