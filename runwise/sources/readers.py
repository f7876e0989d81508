"""Readers for the input files (S1-S6): columns are found by the names in the header.

Files may hold more columns, in any order; every column used is text, and the typed projections in
``operators.network`` and ``operators.landings`` convert it.  A missing name is an error, and so
is a set of files whose headers differ.  Parquet copies read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runwise.constants import AIRPORT_NAMES

FLIGHT_COLUMNS = ["callsign", "runway", "positions", "links", "depAirport", "arrAirport", "aircraftType", "arrGate"]


def _read(spark: SparkSession, path: str, cols: list[str], fmt: str, keep: list[str] | None = None) -> DataFrame:
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    missing = [c for c in [*cols, *(keep or [])] if c.lower() not in {x.lower() for x in df.columns}]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(df.columns)}")
    return df


def read_flights(spark: SparkSession, path: str, fmt: str = "csv", keep: list[str] | None = None) -> DataFrame:
    """Landing records (glob allowed); the used columns and ``keep``, all as text."""
    cols = [*(keep or []), *FLIGHT_COLUMNS]
    return _read(spark, path, FLIGHT_COLUMNS, fmt, keep).select(*[F.col(c).cast("string").alias(c) for c in cols])


def read_nodes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: vertices; the typed projection keeps nodeID, nodeName, latitude, longitude."""
    cols = ["nodeID", "nodeName", "latitude", "longitude"]
    return _read(spark, path, cols, fmt).select(*[F.col(c).alias(c) for c in cols])


def read_links(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: LinkID, LinkName, NodeNameFrom, NodeNameTo, Length (feet), and the row's place in the file."""
    cols = ["LinkID", "LinkName", "NodeNameFrom", "NodeNameTo", "Length"]
    return _read(spark, path, cols, fmt).select(*[F.col(c).alias(c) for c in cols], F.monotonically_increasing_id().alias("row_order"))


def read_size_classes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """ACTypes, Category -> (ac_type, category, row_order); the first row per type wins downstream."""
    df = _read(spark, path, ["ACTypes", "Category"], fmt)
    return df.select(F.col("ACTypes").alias("ac_type"), F.col("Category").alias("category"),
                     F.monotonically_increasing_id().alias("row_order"))


def read_exit_boxes(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """exitID, lat, longUpper, longLower -> typed boxes with their file order.

    Boxes are a config of a few dozen rows of one file, so one ordered window numbers them.
    """
    df = _read(spark, path, ["exitID", "lat", "longUpper", "longLower"], fmt)
    return df.select(F.col("exitID").alias("exit_id"),
                     F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("int").alias("box_order"),
                     F.col("lat").cast("double").alias("lat"), F.col("longUpper").cast("double").alias("long_upper"),
                     F.col("longLower").cast("double").alias("long_lower"))


def airport_code(name) -> F.Column:
    """Airport name or code (any case) -> ICAO code; unknown -> NULL."""
    m = F.create_map(*[x for k, v in AIRPORT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.upper(F.col(name) if isinstance(name, str) else name))
