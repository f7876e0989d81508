"""Runway-occupancy / taxi times from paths, size classes, dollar costs and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.constants import (AIRPORT_SAVINGS_FACTOR, CREW_RATE, DEFAULT_SIZE_CLASS, ENV_RATE, FEET_TO_M, FUEL_RATE,
                               MAINT_RATE, OTHER_RATE, OWNERSHIP_RATE, PASSENGER_RATE, ROT_BENEFIT, SLOW_SPEED_MS,
                               TAXI_SPEED_MS)

COST_PARTS = [("Pcost", None), ("FuelCost", FUEL_RATE), ("CrewCost", CREW_RATE), ("MaintCost", MAINT_RATE),
              ("AOCost", OWNERSHIP_RATE), ("EnvCost", ENV_RATE), ("OtherCost", OTHER_RATE)]
MEASURES = ["optROT", "optTT", "actualROT", "actualTT",
            "optPcost", "optFuelCost", "optCrewCost", "optMaintCost", "optAOCost", "optEnvCost", "optOtherCost",
            "actualPcost", "actualFuelCost", "actualCrewCost", "actualMaintCost", "actualAOCost", "actualEnvCost",
            "actualOtherCost", "savings", "totalOptCost", "totalActualCost"]


def _length_sum(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["length"])


def _exit_index(path: Column) -> Column:
    """1-based position of the first flagged step, 0 when none."""
    return F.array_position(F.transform(path, lambda s: s["is_exit"] == 1), True)


def rot_seconds(path: Column) -> Column:
    """Sum of lengths up to and including the first flagged step (feet -> m) / 50 m/s; -1 if none."""
    k = _exit_index(path)
    return F.when(k > 0, _length_sum(F.slice(path, 1, k.cast("int"))) * FEET_TO_M / SLOW_SPEED_MS) \
        .otherwise(F.lit(-1.0))


def taxi_seconds(path: Column) -> Column:
    """Sum of lengths after the first flagged step (whole path if none) / 11.83 m/s; -1 if empty."""
    k = _exit_index(path)
    n = F.size(path)
    rest = F.slice(path, (k + 1).cast("int"), F.greatest(n - k, F.lit(0)).cast("int"))
    return F.when(n - k > 0, _length_sum(rest) * FEET_TO_M / TAXI_SPEED_MS).otherwise(F.lit(-1.0))


def with_times(df: DataFrame, opt: str = "optPath", pred: str = "predPath") -> DataFrame:
    """optROT, optTT, actualROT, actualTT (the 'actual' figures come from the predicted exit); P13 drops -1 rows."""
    d = df.withColumn("optROT", rot_seconds(F.col(opt))).withColumn("optTT", taxi_seconds(F.col(opt))) \
        .withColumn("actualROT", rot_seconds(F.col(pred))).withColumn("actualTT", taxi_seconds(F.col(pred)))
    return valid_times(d)


def valid_times(df: DataFrame) -> DataFrame:
    return df.where((F.col("optROT") != -1) & (F.col("optTT") != -1)
                    & (F.col("actualROT") != -1) & (F.col("actualTT") != -1))


def first_per_type(sizes: DataFrame) -> DataFrame:
    """One category per aircraft type (the first row of the config wins; lowest category on ties of order)."""
    if "row_order" in sizes.columns:
        return sizes.groupBy("ac_type").agg(F.min_by("category", "row_order").alias("category"))
    return sizes.groupBy("ac_type").agg(F.min("category").alias("category"))


def with_size_class(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """size_class: category of the aircraft type, GA when unknown (Spark chooses the join by the size of ``sizes``)."""
    s = first_per_type(sizes).withColumnRenamed("ac_type", "aircraftType").withColumnRenamed("category", "size_class")
    return df.join(s, "aircraftType", "left").withColumn(
        "size_class", F.coalesce(F.col("size_class"), F.lit(DEFAULT_SIZE_CLASS)))


def passenger_rate(category: Column) -> Column:
    m = F.create_map(*[x for k, v in PASSENGER_RATE.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, category), F.lit(0.0))


def airport_factor(code: str) -> float:
    return float(AIRPORT_SAVINGS_FACTOR.get(code, 0.0))


def with_costs(df: DataFrame, code: str) -> DataFrame:
    """7 costs for the optimal and the predicted path, savings and totals."""
    rate = passenger_rate(F.col("size_class"))
    cols = {}
    for side in ("opt", "actual"):
        t = F.col(f"{side}ROT") + F.col(f"{side}TT")
        for name, r in COST_PARTS:
            cols[f"{side}{name}"] = t * (rate if r is None else F.lit(r))
    d = df.withColumns(cols)
    d = d.withColumn("savings", (F.col("actualROT") - F.col("optROT")) * airport_factor(code) * ROT_BENEFIT)
    for side, total in (("opt", "totalOptCost"), ("actual", "totalActualCost")):
        parts = [F.col(f"{side}{name}") for name, _ in COST_PARTS]
        acc = parts[0]
        for p in parts[1:]:
            acc = acc + p
        d = d.withColumn(total, acc)
    return d
