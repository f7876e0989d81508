"""Packed-text parsing (positions, link sequences, epoch notation) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def items(text: Column) -> Column:
    """Split on '|' dropping trailing empty items (the input files' split rule)."""
    return F.split(F.regexp_replace(text, r"\|+$", ""), r"\|")


def item_count(text: Column) -> Column:
    return F.when(F.regexp_replace(text, r"\|+$", "") == "", F.lit(0)).otherwise(F.size(items(text)))


def epoch_ms(text: Column) -> Column:
    """`m.mmmEk` text -> epoch millis: (m * 10^k) truncated to long; NULL when malformed or when no long holds it."""
    parts = F.split(text, "E")
    m = F.get(parts, 0).try_cast("double")
    k = F.get(parts, 1).try_cast("double")
    return F.when(F.size(parts) >= 2, (m * F.pow(F.lit(10.0), k)).try_cast("long"))


def parse_positions(text: Column) -> Column:
    """'lat;long;epoch|…' -> array<struct<lat double, long double, epoch_ms bigint>>."""
    def one(item: Column) -> Column:
        f = F.split(item, ";")
        return F.struct(F.get(f, 0).try_cast("double").alias("lat"),
                        F.get(f, 1).try_cast("double").alias("long"),
                        epoch_ms(F.get(f, 2)).alias("epoch_ms"))
    return F.transform(items(text), one)


def parse_link_ids(text: Column) -> Column:
    """'?;?;?;linkID|…' -> array<string> of link ids (field index 3)."""
    return F.transform(items(text), lambda item: F.get(F.split(item, ";"), 3))
