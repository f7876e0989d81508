"""Landing records: filters, features, traffic and exit labels.

All per-landing work is row-local (array functions on the landing's own
positions and links), so none of it shuffles the landing table.  The only
shuffle is the traffic count, which runs on pre-aggregated epochs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwise.constants import (BOX_ANGLE_TOLERANCE, BOX_LAT_TOLERANCE, DECEL_CUT, DECEL_POSITIONS, MIN_ITEMS,
                               TRAFFIC_HALF_WINDOW_MS)
from runwise.functions.geo import flat_angle, ieee_div, let, pair_distances
from runwise.functions.parse import item_count, parse_link_ids, parse_positions
from runwise.operators.routes import with_looked_up

RAW_COLUMNS = ["callsign", "runway", "positions", "links", "depAirport", "arrAirport", "aircraftType", "arrGate"]


# --- P1-P5 on the packed-text table ----------------------------------------
def arrivals(df: DataFrame, code: str) -> DataFrame:
    """Keep arrivals at ``code`` (departures and stray header rows fall out)."""
    return df.where(F.col("arrAirport") == code)


def prune(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    extra = [c for c in (keep or []) if c in df.columns and c not in RAW_COLUMNS]
    return df.select(*extra, *RAW_COLUMNS)


def drop_null_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows where any column holds the text "null" (a real NULL also drops)."""
    cols = cols or RAW_COLUMNS
    return df.where(reduce(lambda a, b: a & b, [F.col(c) != "null" for c in cols]))


def min_items(df: DataFrame, n: int = MIN_ITEMS) -> DataFrame:
    """``links`` and ``positions`` must have more than ``n`` items (trailing empties not counted)."""
    return df.where((item_count(F.col("links")) > n) & (item_count(F.col("positions")) > n))


DEN_LINK_PATTERN = r";10\d\d\d(\||$)"


def den_patch(df: DataFrame, code: str, strict: bool = False) -> DataFrame:
    """Denver only: links must mention a 10xxx link id (intended meaning); ``strict`` keeps
    the literal full-match rule, which no record with more than 5 links can pass."""
    if "DEN" not in code:
        return df
    if strict:
        return df.where(F.col("links").rlike(r"^(;10\d\d\d|)$"))
    return df.where(F.col("links").rlike(DEN_LINK_PATTERN))


def parse_flights(raw: DataFrame) -> DataFrame:
    """Packed text -> typed landing rows (positions array<struct>, link_ids array<string>)."""
    fid = F.col("flight_id") if "flight_id" in raw.columns else F.xxhash64("callsign", "positions", "links")  # repeated records share it
    return raw.select(fid.alias("flight_id"), "callsign", "runway", "depAirport", "arrAirport", "aircraftType",
                      "arrGate", parse_positions(F.col("positions")).alias("positions"),
                      parse_link_ids(F.col("links")).alias("link_ids"),
                      *[c for c in raw.columns if c == "surrogate_exit"])


def filter_flights(raw: DataFrame, code: str, strict_den: bool = False) -> DataFrame:
    """P1 -> P2 -> P3 -> P4 -> P5 in the input's order."""
    keep = [c for c in ("flight_id", "surrogate_exit") if c in raw.columns]
    df = prune(arrivals(raw, code), keep)
    df = drop_null_text(df)
    df = min_items(df)
    return den_patch(df, code, strict_den)


def typed_filters(df: DataFrame, code: str) -> DataFrame:
    """P1/P3/P4 on an already typed landing table."""
    text_cols = ["callsign", "runway", "depAirport", "arrAirport", "aircraftType", "arrGate"]
    cond = reduce(lambda a, b: a & b, [F.col(c) != "null" for c in text_cols])
    return df.where((F.col("arrAirport") == code) & cond
                    & (F.size("link_ids") > MIN_ITEMS) & (F.size("positions") > MIN_ITEMS))


# --- E3, E5-E8 ------------------------------------------------------------
def carrier(callsign: Column) -> Column:
    return F.regexp_replace(callsign, r"\d", "")


def with_touchdown(df: DataFrame) -> DataFrame:
    first = F.get(F.col("positions"), 0)
    return df.withColumn("touchdownLat", first["lat"]).withColumn("touchdownLong", first["long"])


def with_hour_day(df: DataFrame) -> DataFrame:
    """Hour "HH" and short weekday "E" of the first position, session time zone (UTC)."""
    ts = F.timestamp_millis(F.get(F.col("positions"), 0)["epoch_ms"])
    return df.withColumn("hour", F.date_format(ts, "HH")).withColumn("day", F.date_format(ts, "E"))


def decel_points(positions: Column) -> Column:
    """The four positions that deceleration needs: the first two and the last two of the first <= 20."""
    m = F.least(F.size(positions), F.lit(DECEL_POSITIONS))
    return F.array(F.get(positions, 0), F.get(positions, 1), F.get(positions, m - 2), F.get(positions, m - 1))


def decel(points: Column, distances: Column) -> Column:
    """Deceleration from ``decel_points`` and their pair distances, 2 decimals HALF_UP; NULL if not finite.

    (speed of the last pair - speed of the first pair) / whole seconds between
    the 2nd and the last position (integer division of the millisecond gap).
    """
    p0, p1, pa, pb = (F.get(points, k) for k in range(4))

    def secs(a: Column, b: Column) -> Column:
        return F.abs(a["epoch_ms"].cast("double") - b["epoch_ms"].cast("double")) / 1000

    diff = ieee_div(F.get(distances, 2), secs(pa, pb)) - ieee_div(F.get(distances, 0), secs(p0, p1))
    whole_secs = F.floor(F.abs(pb["epoch_ms"] - p1["epoch_ms"]) / 1000).cast("double")
    finite = lambda r: ~F.isnan(r) & (F.abs(r) != F.lit(float("inf")))
    # ``let``: each step is computed once, instead of being repeated inside the next.
    return let(diff, lambda x: let(ieee_div(x, whole_secs), lambda r: F.when(finite(r), F.round(r, 2))))


def with_decel(df: DataFrame) -> DataFrame:
    """``decel`` of every landing with two positions or more; only four points reach the geodesic."""
    d = df.withColumn("_pts", F.when(F.size("positions") >= 2, decel_points(F.col("positions"))))
    d = d.withColumn("_pd", pair_distances(F.col("_pts")))
    return d.withColumn("decel", decel(F.col("_pts"), F.col("_pd"))).drop("_pd", "_pts")


def decel_filter(df: DataFrame, cut: float = DECEL_CUT) -> DataFrame:
    return df.where(F.col("decel") <= cut)


def with_carrier(df: DataFrame) -> DataFrame:
    return df.withColumn("carrier", carrier(F.col("callsign")))


def with_landing_epoch(df: DataFrame) -> DataFrame:
    return df.withColumn("landingEpoch", F.get(F.col("positions"), 0)["epoch_ms"])


# --- A1 traffic -----------------------------------------------------------
# Time slices of the running count; any length gives the same result.
TRAFFIC_SLICE_MS = 6 * 3600 * 1000


def traffic_by_epoch(epochs: DataFrame, epoch_col: str = "landingEpoch",
                     half_ms: int = TRAFFIC_HALF_WINDOW_MS) -> DataFrame:
    """(epoch, traffic): landings with epoch strictly within +-half_ms, itself included.

    Landings are counted per distinct epoch first (one hot epoch collapses to one row).  With C(t)
    the landings up to t, the result is C(epoch + half - 1) - C(epoch - half).  Each epoch gives
    its count and two questions on the time line; one running sum in each time slice, plus the
    totals of earlier slices, answers all of them, so the work is linear in the epochs.
    """
    counts = epochs.where(F.col(epoch_col).isNotNull()).groupBy(epoch_col).agg(F.count(F.lit(1)).alias("_n"))
    e = F.col(epoch_col)
    marks = F.explode(F.array(
        F.struct(e.alias("t"), F.lit(0).alias("ask"), F.col("_n").alias("n")),
        F.struct((e + half_ms - 1).alias("t"), F.lit(1).alias("ask"), F.lit(0).cast("long").alias("n")),
        F.struct((e - half_ms).alias("t"), F.lit(-1).alias("ask"), F.lit(0).cast("long").alias("n"))))
    line = counts.select(e, marks.alias("m")).select(
        epoch_col, "m.t", "m.ask", "m.n", F.floor(F.col("m.t") / TRAFFIC_SLICE_MS).alias("_slice"))
    within = Window.partitionBy("_slice").orderBy("t", F.when(F.col("ask") == 0, 0).otherwise(1)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per slice of time: as many as the time range has slices, whatever the number of landings.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = line.groupBy("_slice").agg(F.sum("n").alias("_total"))
    totals = totals.select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    upto = line.withColumn("_upto", F.sum("n").over(within)).where("ask <> 0").join(totals, "_slice")
    value = F.col("ask") * (F.col("_upto") + F.col("_before"))
    return upto.groupBy(epoch_col).agg(F.sum(value).cast("long").alias("traffic"))


def with_traffic(df: DataFrame, epoch_col: str = "landingEpoch", half_ms: int = TRAFFIC_HALF_WINDOW_MS) -> DataFrame:
    """Join the per-epoch traffic back (AQE broadcasts it when its measured size is small)."""
    t = traffic_by_epoch(df.select(epoch_col), epoch_col, half_ms)
    return df.join(t, epoch_col, "left")


# --- J4 / J5 labels ---------------------------------------------------------
def label_exit(df: DataFrame, exit_ids: DataFrame) -> DataFrame:
    """exit = first link id after item 0 that is an exit link; NULL when none.  Each distinct link list is labelled once."""
    ex = exit_ids.select("link_id").distinct().withColumn("info", F.col("link_id"))
    d = with_looked_up(df, ex, "_exits")
    later = F.filter("_exits", lambda x, i: (i > 0) & x.isNotNull())
    return d.select(*df.columns, F.get(later, 0).alias("exit"))


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("exit").isNotNull())


def check_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with ``usable``: no position can lie in a box whose |lower| is not below its |upper|."""
    return boxes.withColumn("usable", F.coalesce(F.abs("long_lower") < F.abs("long_upper"), F.lit(False)))


# Cells of the box join: as high as a box, and about as wide as one.  Any sizes give the same labels.
CELL_LAT = 2 * BOX_LAT_TOLERANCE
CELL_LONG = 0.001


def box_cells(boxes: DataFrame) -> DataFrame:
    """Usable boxes (``_lat``, ``_up``, ``_lo``), one row for each cell of the latitude x longitude grid that they touch."""
    lat, up, lo = F.abs("lat"), F.abs("long_upper"), F.abs("long_lower")
    b = check_boxes(boxes).where("usable").select(
        "exit_id", "box_order", lat.alias("_lat"), up.alias("_up"), lo.alias("_lo"),
        F.explode(F.sequence(F.floor((lat - BOX_LAT_TOLERANCE) / CELL_LAT), F.floor((lat + BOX_LAT_TOLERANCE) / CELL_LAT))).alias("_row"))
    return b.select("*", F.explode(F.sequence(F.floor(F.col("_lo") / CELL_LONG), F.floor(F.col("_up") / CELL_LONG))).alias("_col"))


def box_candidates(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Positions (``_plat``, ``_plong``) with the boxes that touch their cell: no more than overlap one cell."""
    cells = points.withColumn("_row", F.floor(F.col("_plat") / CELL_LAT)).withColumn("_col", F.floor(F.col("_plong") / CELL_LONG))
    return cells.join(box_cells(boxes), ["_row", "_col"]).drop("_row", "_col")


def label_exit_by_box(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """exit = first position after item 0 inside an exit box (first box in config order wins), else NULL.

    Box test on absolute coordinates: |lat - box.lat| < 0.00016, |box.lower| < long < |box.upper|,
    and the angle from touchdown within 4 degrees of the runway angle (touchdown to position 3).
    Positions meet boxes by an equi-join on cells of a latitude x longitude grid, so neither the boxes of one runway nor
    its positions share one key.  ``labelled_only`` drops the landings outside every box.
    """
    pos = F.col("positions")
    n = F.size(pos)
    td_lat, td_long = F.abs(F.get(pos, 0)["lat"]), F.abs(F.get(pos, 0)["long"])
    nxt = F.get(pos, F.when(n > 3, F.lit(3)).otherwise(n - 1))
    rwy_angle = flat_angle(td_long, td_lat, F.abs(nxt["long"]), F.abs(nxt["lat"]))
    # Each distinct trajectory is labelled once and joined back by its fingerprint and touchdown.
    keyed = df.withColumn("_key", F.struct(F.xxhash64("positions").alias("h"), F.size("positions").alias("n"), F.get(pos, 0).alias("p")))
    points = keyed.dropDuplicates(["_key"]).select(
        "_key", rwy_angle.alias("_rwy"), td_lat.alias("_tlat"), td_long.alias("_tlong"), F.posexplode("positions").alias("_pos", "_p"))
    points = points.where("_pos >= 1").select("_key", "_rwy", "_tlat", "_tlong", "_pos", F.abs("_p.lat").alias("_plat"),
                                              F.abs("_p.long").alias("_plong"))
    angle = flat_angle(F.col("_tlong"), F.col("_tlat"), F.col("_plong"), F.col("_plat"))
    inside = box_candidates(points, boxes).where(
        (F.abs(F.col("_plat") - F.col("_lat")) < BOX_LAT_TOLERANCE) & (F.col("_plong") < F.col("_up"))
        & (F.col("_plong") > F.col("_lo")) & (F.abs(F.col("_rwy") - angle) < BOX_ANGLE_TOLERANCE))
    found = inside.groupBy("_key").agg(F.min_by("exit_id", F.struct("_pos", "box_order")).alias("exit"))
    return keyed.join(found, "_key", "left").select(*df.columns, "exit")


def select_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), "exit", *features, "positions", "link_ids")
