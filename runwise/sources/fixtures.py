"""Domain inputs derived from the driver's tables (deterministic, SQL-expressible).

* taxiway network: a 25 x 5 grid from ``nation`` (column c) and ``region`` (row r)
* landings: chunks of up to 10 consecutive ``events`` of one user become one landing, with
  short, long, off-axis, mislabelled and cut records among them, so that every filter has rows to drop
* aircraft size classes: from the distinct ``part`` brands
* exit boxes: one box around the runway end of every exit link

Every builder is a plain DataFrame plan over the given tables, so its work
grows with them.  ``runwise.plans.oracles`` holds the same rules as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwise.operators.numbering import number_within
from runwise.session import materialise

# FIXED VALUES of the fixture layout (grid geometry and synthetic motion).
GRID_COLS = 25                 # nation keys 0..24
GRID_ROWS = 5                  # region keys 0..4
BASE_LAT = 33.43
BASE_LONG = -112.03
STEP_LAT = 0.0015
STEP_LONG = 0.0012
H_BASE_FT = 306000 * 0.0012    # horizontal link base length, feet
V_BASE_FT = 365000 * 0.0015    # vertical link base length, feet
EVENTS_PER_LANDING = 10
LONG_LANDING = 24              # positions of landings of every ninth user: more than deceleration reads
LAT_DRIFT = [0.0, 0.00002, -0.00004, 0.0, 0.0]   # degrees per position, by user
VARIANTS = 11                  # kinds of link lists, by user and chunk
METRES_PER_DEG_LONG = 92900.0
CALLSIGN_PREFIXES = ["AAL", "SWA", "UAL"]
SIZE_CATEGORIES = ["GA", "Small", "Medium", "Large", "Super"]
BOX_HALF_WIDTH = 0.0006
BOX_LAT_SHIFT = [0.00017, 0.0, -0.0003]   # degrees off the runway axis of the first boxes, so landings differ in the box they meet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node_name(r: F.Column, c: F.Column) -> F.Column:
    return F.when(r == 0, F.concat(F.lit("07L/25R."), c.cast("string"))) \
        .otherwise(F.concat(F.lit("T"), r.cast("string"), F.lit("."), c.cast("string")))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c) cells: every nation column paired with every region row by an equi-join."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rk"))
    rows = nation.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(GRID_ROWS - 1))))
    return rows.join(region, rows.r == region.rk, "inner").select("r", "c")


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with the input-file column names (nodeID, nodeName, latitude, longitude)."""
    g = grid_cells(spark, sf_dir)
    return g.select(
        (F.col("r") * GRID_COLS + F.col("c")).cast("string").alias("nodeID"),
        _node_name(F.col("r"), F.col("c")).alias("nodeName"),
        (F.lit(BASE_LAT) + F.lit(STEP_LAT) * F.col("r")).alias("latitude"),
        (F.lit(BASE_LONG) + F.lit(STEP_LONG) * F.col("c")).alias("longitude"),
    )


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (LinkID, LinkName, NodeNameFrom, NodeNameTo, Length in feet) between grid neighbours."""
    g = grid_cells(spark, sf_dir)
    a = g.select(F.col("r").alias("r1"), F.col("c").alias("c1"))
    b = g.select(F.col("r").alias("r2"), F.col("c").alias("c2"))
    horiz = a.join(b, (a.r1 == b.r2) & (a.c1 + 1 == b.c2)).select(
        (F.lit(1000) + F.col("r1") * GRID_COLS + F.col("c1")).alias("id"),
        _node_name(F.col("r1"), F.col("c1")).alias("NodeNameFrom"),
        _node_name(F.col("r2"), F.col("c2")).alias("NodeNameTo"),
        F.lit(H_BASE_FT).alias("base"))
    vert = a.join(b, (a.r1 + 1 == b.r2) & (a.c1 == b.c2)) \
        .where((F.col("r1") > 0) | (F.col("c1") % 3 == 1)).select(
        (F.lit(2000) + F.col("r1") * GRID_COLS + F.col("c1")).alias("id"),
        _node_name(F.col("r1"), F.col("c1")).alias("NodeNameFrom"),
        _node_name(F.col("r2"), F.col("c2")).alias("NodeNameTo"),
        F.lit(V_BASE_FT).alias("base"))
    horiz = horiz.withColumn("LinkName", F.concat_ws("_", "NodeNameFrom", "NodeNameTo"))
    vert = vert.withColumn("LinkName", F.concat_ws("_", "NodeNameTo", "NodeNameFrom"))
    both = horiz.unionByName(vert)
    return both.select(
        F.col("id").cast("string").alias("LinkID"), "LinkName", "NodeNameFrom", "NodeNameTo",
        F.round(F.col("base") * (1 + ((F.col("id") * 37) % 11) / 100.0), 3).alias("Length"))


def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ac_type, category): part brands; brands numbered 7k are left out (GA default)."""
    brand_no = F.regexp_extract("p_brand", r"#(\d+)$", 1).cast("int")
    return (table(spark, sf_dir, "part").select("p_brand").distinct()
            .where(brand_no % 7 != 0)
            .select(F.col("p_brand").alias("ac_type"),
                    F.get(F.array(*[F.lit(c) for c in SIZE_CATEGORIES]), brand_no % 5).alias("category")))


def _landing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk of up to 10 events of a user: (u, chunk, n events, t0 epoch ms)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    numbered = number_within(ev, "user_id", ["ts", "event_id"], "rn", F.to_date("ts"))
    return (numbered.withColumn("chunk", F.floor((F.col("rn") - 1) / EVENTS_PER_LANDING))
            .groupBy("user_id", "chunk")
            .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t_first"))
            .select(F.col("user_id").alias("u"), F.col("chunk").cast("bigint").alias("chunk"), "n",
                    F.floor(F.unix_micros(F.col("t_first").cast("timestamp")) / 1000).cast("bigint").alias("t0")))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed landing records, written once like an input table.

    Columns: flight_id, callsign, runway, depAirport, arrAirport, aircraftType, arrGate,
    positions array<struct<lat,long,epoch_ms>>, link_ids array<string>, surrogate_exit.
    """
    return materialise(_flights(spark, sf_dir))


def _flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _landing_chunks(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("depAirport"))
    u, chunk = F.col("u"), F.col("chunk")
    v0 = F.lit(55) + u % 15
    acc = F.when(u % 10 == 0, F.lit(0.2)).otherwise(F.lit(1.0) + F.lit(0.5) * (chunk % 3))
    n_pos = F.when((F.col("n") == EVENTS_PER_LANDING) & (u % 9 == 4), F.lit(LONG_LANDING)).otherwise(F.col("n")).cast("int")
    drift = F.get(F.array(*[F.lit(x) for x in LAT_DRIFT]), (u % len(LAT_DRIFT)).cast("int"))
    degrees = lambda x: x.cast("decimal(12,7)").cast("double")  # noqa: E731  (what the packed text holds)
    positions = F.transform(
        F.sequence(F.lit(0), n_pos - 1),
        lambda s: F.struct(
            degrees(F.lit(BASE_LAT) + drift * s).alias("lat"),
            degrees(F.lit(BASE_LONG) + ((v0 * (2 * s)) - (acc / 2.0) * ((2 * s) * (2 * s))) / METRES_PER_DEG_LONG).alias("long"),
            (F.col("t0") + F.lit(2000) * s).cast("bigint").alias("epoch_ms")))
    e = F.lit(10) + F.lit(3) * (u % 3)
    g = e + 3 + u % 4
    route = F.concat(
        F.transform(F.sequence(F.lit(1000), F.lit(1000) + e - 1), lambda x: x.cast("string")),
        F.array((F.lit(2000) + e).cast("string")),
        F.transform(F.sequence(F.lit(1025) + e, F.lit(1025) + g - 1), lambda x: x.cast("string")),
        F.array((F.lit(2025) + g).cast("string")))
    kind = (u + chunk) % VARIANTS
    unknown = F.array(F.concat(F.lit("10"), F.lpad((u % 1000).cast("string"), 3, "0")))
    text = lambda xs: F.transform(xs, lambda x: x.cast("string"))
    early = F.concat(F.array(F.lit("1000"), F.lit("2001")), text(F.sequence(F.lit(1026), F.lit(1025) + g - 1)),
                     text(F.array(F.lit(2025) + g, F.lit(1050) + g, F.lit(1051) + g)))
    cut_off = F.concat(unknown, F.array(*[F.lit(x) for x in ("2001", "1026", "1027", "1001", "1000")]))
    link_ids = (F.when((u % 30 == 15) & (chunk % 3 == 2), cut_off)    # the goal can't be reached without the avoided vertex
                .when(kind == 2, early)                               # off the runway before it is slow: no exit on the way
                .when(kind == 3, F.concat(unknown, route))            # unknown first link
                .when(kind == 5, F.concat(route, unknown))            # unknown last link: no goal
                .when(kind == 7, F.slice(route, 1, e + 2))            # cut short: start and goal meet
                .when(kind == 8, F.transform(F.sequence(F.lit(2025) + u % 20, F.lit(2030) + u % 20),
                                             lambda x: x.cast("string")))   # links that don't touch each other
                .when(kind == 9, F.slice(route, 1, 4)).otherwise(route))    # too few items
    out = ch.select(
        (u * 10000000 + chunk).alias("flight_id"), u, chunk,
        F.concat(F.get(F.array(*[F.lit(p) for p in CALLSIGN_PREFIXES]), (u % 3).cast("int")), u.cast("string")).alias("callsign"),
        F.when(u % 2 == 0, F.lit("07L")).otherwise(F.lit("25R")).alias("runway"),
        F.lit("KPHX").alias("arrAirport"),
        F.concat(F.lit("Brand#"), (u % 30).cast("string")).alias("aircraftType"),
        F.concat(F.lit("T"), (u % 4).cast("string")).alias("arrGate"),
        positions.alias("positions"), link_ids.alias("link_ids"),
        (F.lit(2000) + e + 3).cast("string").alias("surrogate_exit"),
        (u % 25).cast("int").alias("nk"))
    out = out.join(nation, "nk", "left")
    return out.select("flight_id", "callsign", "runway", "depAirport", "arrAirport", "aircraftType",
                      "arrGate", "positions", "link_ids", "surrogate_exit")


def _num_text(x: F.Column) -> F.Column:
    return x.cast("decimal(12,7)").cast("string")


def _epoch_text(ms: F.Column) -> F.Column:
    """Epoch millis written in the `m.mmmEk` notation of the input files."""
    s = ms.cast("string")
    return F.concat(F.substring(s, 1, 1), F.lit("."), F.substring(s, 2, 40),
                    F.lit("E"), (F.length(s) - 1).cast("string"))


def flights_raw(spark: SparkSession, sf_dir: str, noise: bool = False, malformed: bool = False,
                keep: list[str] | None = None) -> DataFrame:
    """Landing records as packed text, the layout of the input files.

    ``noise=True`` turns every 7th landing into a departure elsewhere and gives
    every 7th+1 landing a literal "null" aircraft type, to exercise the filters.
    ``malformed=True`` makes the first epoch of every 11th+3 landing no number, or one that no long holds.
    """
    f = flights(spark, sf_dir)
    pos_txt = F.concat_ws("|", F.transform(
        "positions", lambda p: F.concat_ws(";", _num_text(p["lat"]), _num_text(p["long"]), _epoch_text(p["epoch_ms"]))))
    link_txt = F.concat_ws("|", F.transform(
        "link_ids", lambda x, i: F.concat_ws(";", F.lit("seg"), i.cast("string"), F.lit("0"), x)))
    arr = F.col("arrAirport")
    ac = F.col("aircraftType")
    if noise:
        arr = F.when(F.col("flight_id") % 7 == 0, F.lit("KLAX")).otherwise(arr)
        ac = F.when(F.col("flight_id") % 7 == 1, F.lit("null")).otherwise(ac)
    if malformed:
        broken = F.when(F.col("flight_id") % 2 == 0, F.lit("n/a")).otherwise(F.lit("9.9E99"))
        pos_txt = F.when(F.col("flight_id") % 11 == 3, F.concat(F.regexp_extract(pos_txt, r"^[^;]*;[^;]*;", 0), broken,
                                                                F.regexp_replace(pos_txt, r"^[^|]*", ""))).otherwise(pos_txt)
    return f.select("flight_id", "callsign", "runway", pos_txt.alias("positions"), link_txt.alias("links"),
                    "depAirport", arr.alias("arrAirport"), ac.alias("aircraftType"), "arrGate", *(keep or []))


def exit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exit box per exit link, around its runway-side node (exit_id, box_order, lat, long_upper, long_lower)."""
    from runwise.operators.network import clean_network
    nodes, edges = clean_network(raw_nodes(spark, sf_dir), raw_links(spark, sf_dir))
    ex = edges.where(F.col("is_exit") == 1).join(
        nodes.select(F.col("node_id").alias("src"), "lat", "long"), "src")
    place = ((F.col("link_id").cast("int") - 2001) / 3).cast("int")
    return ex.select(
        F.col("link_id").alias("exit_id"),
        F.col("link_id").cast("int").alias("box_order"),
        (F.col("lat") + F.coalesce(F.get(F.array(*[F.lit(x) for x in BOX_LAT_SHIFT]), place), F.lit(0.0))).alias("lat"),
        (F.col("long") - BOX_HALF_WIDTH).alias("long_upper"),
        (F.col("long") + BOX_HALF_WIDTH).alias("long_lower"))
