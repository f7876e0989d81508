"""Registered queries: one Spark plan per inventory item, over the driver's tables.

Every query derives its inputs (network, landings, size classes, exit boxes)
from the given tables with ``runwise.sources.fixtures`` and runs over all of
them.  Computed columns carry fixed names so the DuckDB oracles in
``runwise.plans.oracles`` can be compared column by column.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwise.constants import M_TO_FEET
from runwise.functions.geo import flat_angle, pair_distances, pair_speeds, vincenty
from runwise.operators import costs as C
from runwise.operators import landings as L
from runwise.operators import paths as P
from runwise.operators import rejects as J
from runwise.operators import summary as S
from runwise.operators.network import (NetworkIndex, clean_network, exit_edges, link_coords, project_edges, project_vertices,
                                       undirected)
from runwise.operators.overlay import node_overlay, path_overlay
from runwise.plans.prepare import featurize, prepare_from_text, prepare_landings
from runwise.session import cut_lineage, ensure_checkpoint_dir, materialise, prepare
from runwise.sources import readers as R
from runwise.sources import fixtures as fx

CODE = "KPHX"
# FIXED VALUES: airport spellings used to exercise the airport-code lookup.
AIRPORT_SPELLINGS = ["phx", "Phoenix", "ATL", "atlanta", "Bwi", "BALTIMORE", "den", "Denver", "LAX"]
FEATURE_SUBSET = ["runway", "decel", "traffic", "hour", "carrier"]


def network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return clean_network(fx.raw_nodes(spark, sf), fx.raw_links(spark, sf))


def r7(c):
    return F.round(c, 7)


def r6(c):
    return F.round(c, 6)


def r3(c):
    return F.round(c, 3)


# --- sources / network --------------------------------------------------------
def as_file(df: DataFrame, spark: SparkSession, first: str, parts: bool = False) -> str:
    """``df`` as CSV with a header whose columns are in another order and among others: one ordered file, or a folder of
    parts that the tasks write side by side, each with its header.

    Returns its path; the readers must find their columns by name.
    """
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    rest = [c for c in reversed(df.columns) if c != first]
    out = df.select(F.lit("x").alias("extra_first"), *rest, F.lit(1).alias("Extra"), first)
    (out if parts else out.coalesce(1)).write.option("header", True).csv(path)
    return path


def read_network(spark, sf):
    nodes = R.read_nodes(spark, as_file(fx.raw_nodes(spark, sf).withColumnsRenamed(
        {"nodeID": "NodeID", "nodeName": "NodeName", "latitude": "Latitude", "longitude": "Longitude"}), spark, "Latitude"))
    links = R.read_links(spark, as_file(fx.raw_links(spark, sf), spark, "Length"))
    return nodes, links


def q_scan_nodes(spark, sf):
    nodes = project_vertices(read_network(spark, sf)[0])
    return nodes.select("node_id", "node_name", r7(F.col("lat")).alias("lat"), r7(F.col("long")).alias("long"))


def q_scan_links(spark, sf):
    return project_edges(read_network(spark, sf)[1]).select("link_id", "link_name", "node_from", "node_to", "length")


def q_edge_src_join(spark, sf):
    _, edges = network(spark, sf)
    return edges.select("link_id", "src", "dst", "length")


def q_is_exit_link(spark, sf):
    _, edges = network(spark, sf)
    return edges.select("link_id", "link_name", "is_exit")


def q_exit_edges(spark, sf):
    _, edges = network(spark, sf)
    return exit_edges(edges).select("link_id", "link_name", "src", "dst")


def q_link_end_coords(spark, sf):
    nodes, edges = network(spark, sf)
    return link_coords(nodes, edges).select("link_id", *[r7(F.col(c)).alias(c) for c in
                                                         ("src_lat", "src_long", "dst_lat", "dst_long")])


def q_link_by_id(spark, sf):
    nodes, edges = network(spark, sf)
    return link_coords(nodes, edges).where(F.col("link_id") == "2001").select(
        "link_id", "link_name", "src", "dst", r7(F.col("src_lat")).alias("src_lat"), r7(F.col("dst_lat")).alias("dst_lat"))


def q_scan_size_classes(spark, sf):
    """The size table written as a config file with a repeated type, the first row of which wins."""
    sizes = fx.size_classes(spark, sf).withColumnsRenamed({"ac_type": "ACTypes", "category": "Category"})
    again = sizes.select("ACTypes", F.lit("Super").alias("Category"))
    ordered = sizes.withColumn("n", F.lit(0)).unionByName(again.withColumn("n", F.lit(1))).orderBy("n", "ACTypes").drop("n")
    return C.first_per_type(R.read_size_classes(spark, as_file(ordered, spark, "ACTypes")))


def q_scan_exit_boxes(spark, sf):
    """Boxes written as a config file; their order in it is the box order."""
    b = fx.exit_boxes(spark, sf).orderBy("box_order").withColumnsRenamed(
        {"exit_id": "exitID", "long_upper": "longUpper", "long_lower": "longLower"}).drop("box_order")
    b = R.read_exit_boxes(spark, as_file(b, spark, "lat"))
    return b.select("exit_id", "box_order", *[r7(F.col(c)).alias(c) for c in ("lat", "long_upper", "long_lower")])


def q_airport_code(spark, sf):
    n = fx.table(spark, sf, "nation")
    spelled = F.get(F.array(*[F.lit(x) for x in AIRPORT_SPELLINGS]), (F.col("n_nationkey") % len(AIRPORT_SPELLINGS)).cast("int"))
    return n.select("n_nationkey", spelled.alias("airport")).select("n_nationkey", "airport",
                                                                   R.airport_code(F.col("airport")).alias("code"))


# --- landings: parsing and filters -------------------------------------------
def read_back(spark, sf, noise: bool = False):
    """The packed landing records, read from a file by the names in its header."""
    raw = fx.flights_raw(spark, sf, noise)
    return R.read_flights(spark, as_file(raw, spark, "positions", parts=True), keep=["flight_id"])


def q_scan_flights(spark, sf):
    t = L.parse_flights(read_back(spark, sf))
    p, link = F.col("positions"), F.col("link_ids")
    return t.select(F.col("flight_id").cast("long").alias("flight_id"), F.size(p).alias("n_positions"), F.size(link).alias("n_links"),
                    F.get(p, 0)["epoch_ms"].alias("first_epoch"), F.get(p, F.size(p) - 1)["epoch_ms"].alias("last_epoch"),
                    r7(F.get(p, 1)["long"]).alias("second_long"),
                    F.get(link, 0).alias("first_link"), F.get(link, F.size(link) - 1).alias("last_link"))


def q_arrivals_only(spark, sf):
    return L.arrivals(fx.flights_raw(spark, sf, noise=True), CODE).select("flight_id")


def q_drop_null_literals(spark, sf):
    return L.drop_null_text(L.arrivals(fx.flights_raw(spark, sf, noise=True), CODE)).select("flight_id")


def q_min_items(spark, sf):
    return L.min_items(L.drop_null_text(L.arrivals(fx.flights_raw(spark, sf, noise=True), CODE))).select("flight_id")


def q_den_link_patch(spark, sf):
    return L.den_patch(fx.flights_raw(spark, sf), "KDEN").select("flight_id")


# --- landing features -----------------------------------------------------------
def q_touchdown(spark, sf):
    d = L.with_touchdown(fx.flights(spark, sf))
    return d.select("flight_id", r7(F.col("touchdownLat")).alias("touchdownLat"), r7(F.col("touchdownLong")).alias("touchdownLong"))


def q_hour_day(spark, sf):
    return L.with_hour_day(fx.flights(spark, sf)).select("flight_id", "hour", "day")


def q_landing_epoch(spark, sf):
    return L.with_landing_epoch(fx.flights(spark, sf)).select("flight_id", "landingEpoch")


def q_carrier(spark, sf):
    return L.with_carrier(fx.flights(spark, sf)).select("flight_id", "carrier")


def q_decel(spark, sf):
    return L.with_decel(fx.flights(spark, sf)).select("flight_id", "decel")


def q_decel_filter(spark, sf):
    return L.decel_filter(L.with_decel(fx.flights(spark, sf))).select("flight_id", "decel")


def q_traffic(spark, sf):
    return featurize(L.typed_filters(fx.flights(spark, sf), CODE)).select("flight_id", "landingEpoch", "traffic")


def q_label_real_exit(spark, sf):
    _, edges = network(spark, sf)
    return L.label_exit(featurize(L.typed_filters(fx.flights(spark, sf), CODE)), exit_edges(edges)).select("flight_id", "exit")


def q_labelled_only(spark, sf):
    _, edges = network(spark, sf)
    return L.labelled_only(L.label_exit(featurize(L.typed_filters(fx.flights(spark, sf), CODE)), exit_edges(edges))).select("flight_id", "exit")


def q_label_exit_geofence(spark, sf):
    return L.label_exit_by_box(fx.flights(spark, sf), fx.exit_boxes(spark, sf)).select("flight_id", "exit")


PREPARED_COLS = ["flight_id", "exit", "runway", "depAirport", "aircraftType", "arrGate", "touchdownLat", "touchdownLong",
                 "hour", "day", "decel", "carrier", "traffic"]


def q_prepare_landings(spark, sf):
    """F1 from the packed text of the input files."""
    _, edges = network(spark, sf)
    p = prepare_from_text(read_back(spark, sf, noise=True), edges, CODE).withColumn("flight_id", F.col("flight_id").cast("long"))
    return p.select(*[r7(F.col(c)).alias(c) if c.startswith("touchdown") else c for c in PREPARED_COLS])


def q_select_features(spark, sf):
    _, edges = network(spark, sf)
    return prepare_landings(fx.flights(spark, sf), edges, CODE, features=FEATURE_SUBSET) \
        .select("flight_id", "exit", *FEATURE_SUBSET)


# --- scalar geometry -------------------------------------------------------------
def _pairs(spark, sf):
    f = fx.flights(spark, sf)
    d = f.select("flight_id", "positions", pair_distances(F.col("positions")).alias("pd"))
    d = d.select("flight_id", F.posexplode(F.arrays_zip(F.col("pd").alias("dist"),
                                                         pair_speeds(F.col("positions"), F.col("pd")).alias("speed"))))
    return d.select("flight_id", F.col("pos").alias("i"), F.col("col")["dist"].alias("dist"), F.col("col")["speed"].alias("speed"))


def q_vincenty_m(spark, sf):
    return _pairs(spark, sf).select("flight_id", "i", r3(F.col("dist")).alias("dist_m"))


def q_pair_speed(spark, sf):
    return _pairs(spark, sf).select("flight_id", "i", r3(F.col("speed")).alias("speed_ms"))


def q_consecutive_pairs(spark, sf):
    f = fx.flights(spark, sf)
    pairs = F.transform(F.sequence(F.lit(0), F.size("link_ids") - 2),
                        lambda i: F.struct(i.alias("idx"), F.get("link_ids", i).alias("link_a"), F.get("link_ids", i + 1).alias("link_b")))
    return f.select("flight_id", F.inline(pairs))


def q_first_last_of_array(spark, sf):
    f = fx.flights(spark, sf)
    n = F.size("link_ids")
    return f.select("flight_id", F.get("link_ids", 0).alias("first_link"), F.get("link_ids", 1).alias("second_link"),
                    F.get("link_ids", n - 2).alias("second_last_link"), F.get("link_ids", n - 1).alias("last_link"))


def q_flat_angle(spark, sf):
    f = fx.flights(spark, sf)
    p0, p3 = F.get("positions", 0), F.get("positions", 3)
    ang = flat_angle(F.abs(p0["long"]), F.abs(p0["lat"]), F.abs(p3["long"]), F.abs(p3["lat"]))
    return f.select("flight_id", r6(ang).alias("angle"))


# --- graph -------------------------------------------------------------------------
def _vertices(spark, sf):
    nodes, edges = network(spark, sf)
    net = NetworkIndex(nodes, edges)
    return materialise(P.with_vertices(fx.flights(spark, sf), net).drop("positions", "link_ids")), nodes, edges, net


def q_slow_vertex(spark, sf):
    v, *_ = _vertices(spark, sf)
    return v.select("flight_id", r7(F.col("slow_lat")).alias("slow_lat"), r7(F.col("slow_long")).alias("slow_long"), "slowV")


def q_goal_vertex(spark, sf):
    v, *_ = _vertices(spark, sf)
    return v.select("flight_id", "goalV")


def q_avoid_vertex(spark, sf):
    v, *_ = _vertices(spark, sf)
    return v.select("flight_id", "avoidV")


def q_planar_link_distance(spark, sf):
    nodes, edges = network(spark, sf)
    net = NetworkIndex(nodes, edges)
    d = P.with_link_info(P.with_slow_position(fx.flights(spark, sf)), net)
    d = d.select("flight_id", F.posexplode(F.transform("_links", lambda e: P.link_distance(e, F.col("slow_lat"), F.col("slow_long")))))
    return d.select("flight_id", F.col("pos").alias("idx"), F.round(F.col("col"), 9).alias("link_dist"))


def q_not_adjacent(spark, sf):
    v, nodes, edges, net = _vertices(spark, sf)
    return P.drop_adjacent(v, edges).select("flight_id", "slowV", "goalV")


def q_nearest_exit_end(spark, sf):
    v, nodes, edges, net = _vertices(spark, sf)
    return P.with_exit_ends(v, net, "surrogate_exit").select("flight_id", "near", "far")


def q_heuristic_ft(spark, sf):
    nodes, edges = network(spark, sf)
    u = undirected(edges).select("a", "b")
    xy = nodes.select("node_id", "lat", "long")
    j = u.join(xy.withColumnRenamed("node_id", "a").withColumnRenamed("lat", "alat").withColumnRenamed("long", "along"), "a") \
        .join(xy.withColumnRenamed("node_id", "b").withColumnRenamed("lat", "blat").withColumnRenamed("long", "blong"), "b")
    return j.select("a", "b", r3(vincenty(F.col("alat"), F.col("along"), F.col("blat"), F.col("blong")) * M_TO_FEET).alias("h_ft"))


def _path_text(col):
    return F.array_join(F.transform(col, lambda s: s["link_id"]), ",")


def q_best_paths(spark, sf):
    v, nodes, edges, net = _vertices(spark, sf)
    keys = P.drop_adjacent(v, edges).select(F.col("slowV").alias("start"), F.col("goalV").alias("goal"),
                                            F.col("avoidV").alias("avoid"))
    bp = P.best_paths(keys, nodes, edges)
    return bp.select("start", "goal", "avoid", _path_text(F.col("path")).alias("path_links"),
                     r3(P.path_length(F.col("path"))).alias("path_ft"))


_MEMO: dict[tuple, DataFrame] = {}


def _sid(spark: SparkSession, sf: str) -> str:
    """Memo key: the application and the input files with their sizes and times, so changed tables count as new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    stamp = "|".join(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return f"{spark.sparkContext.applicationId}-{id(spark)}-{zlib.crc32(stamp.encode()):08x}"


def clear_memo() -> None:
    _MEMO.clear()


def optimised(spark, sf, stop="first_touch") -> DataFrame:
    """F2 on the prepared landings, with the deterministic surrogate as predicted exit.

    The costed table is written once per session to the checkpoint folder and
    shared by the queries that read it (like a materialised view).
    """
    key = (_sid(spark, sf), sf, stop)
    if key not in _MEMO:
        _MEMO[key] = materialise(_optimised(spark, sf, stop))
    return _MEMO[key]


def _optimised(spark, sf, stop="first_touch") -> DataFrame:
    nodes, edges = network(spark, sf)
    p = prepare_landings(fx.flights(spark, sf), edges, CODE, keep=["surrogate_exit"]) \
        .withColumnRenamed("surrogate_exit", "predictedExit")
    from runwise.plans.optimise import optimise
    return optimise(p, nodes, edges, fx.size_classes(spark, sf), CODE, stop=stop)


def _flags(col):
    return F.array_join(F.transform(col, lambda s: s["is_exit"].cast("string")), "")


def q_opt_path(spark, sf):
    o = optimised(spark, sf)
    return o.select("flight_id", "slowV", "goalV", _path_text(F.col("optPath")).alias("opt_links"),
                    _flags(F.col("optPath")).alias("opt_flags"))


def q_predicted_path(spark, sf):
    o = optimised(spark, sf)
    return o.select("flight_id", "predictedExit", _path_text(F.col("predPath")).alias("pred_links"),
                    _flags(F.col("predPath")).alias("pred_flags"))


def q_rot_seconds(spark, sf):
    return optimised(spark, sf).select("flight_id", r6(F.col("optROT")).alias("optROT"), r6(F.col("actualROT")).alias("actualROT"))


def q_taxi_seconds(spark, sf):
    return optimised(spark, sf).select("flight_id", r6(F.col("optTT")).alias("optTT"), r6(F.col("actualTT")).alias("actualTT"))


def q_size_class_join(spark, sf):
    return C.with_size_class(fx.flights(spark, sf), fx.size_classes(spark, sf)).select("flight_id", "aircraftType", "size_class")


def q_cost_rate_lookup(spark, sf):
    d = C.with_size_class(fx.flights(spark, sf), fx.size_classes(spark, sf))
    return d.select("flight_id", "size_class", C.passenger_rate(F.col("size_class")).alias("passenger_rate"))


def q_cost_columns(spark, sf):
    o = optimised(spark, sf)
    cols = [c for c in C.MEASURES if c.endswith("cost") or c.endswith("Cost")]
    cols = [c for c in cols if not c.startswith("total")]
    return o.select("flight_id", *[r6(F.col(c)).alias(c) for c in cols])


def q_savings(spark, sf):
    return optimised(spark, sf).select("flight_id", r6(F.col("savings")).alias("savings"))


def q_cost_totals(spark, sf):
    o = optimised(spark, sf)
    return o.select("flight_id", r6(F.col("totalOptCost")).alias("totalOptCost"),
                    r6(F.col("totalActualCost")).alias("totalActualCost"))


def q_optimise(spark, sf):
    o = optimised(spark, sf)
    return o.select("flight_id", "size_class", *[r6(F.col(c)).alias(c) for c in C.MEASURES])


def q_mean_measures(spark, sf):
    m = S.summarise(optimised(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


def q_describe_measures(spark, sf):
    d = S.describe(optimised(spark, sf))
    return d.select("summary", *[r6(F.col(c)).alias(c) for c in C.MEASURES])


def _impact(fn):
    def q(spark, sf):
        d = fn(optimised(spark, sf))
        return d.select("item", *[r6(F.col(c)).alias(c) for c in ("optimal", "predicted", "difference")])
    return q


def q_distinct_counts(spark, sf):
    _, edges = network(spark, sf)
    return S.distinct_counts(prepare_landings(fx.flights(spark, sf), edges, CODE))


def q_path_length_sums(spark, sf):
    o = optimised(spark, sf)
    k = F.array_position(F.transform("optPath", lambda s: s["is_exit"] == 1), True)
    return o.select("flight_id", r3(P.path_length(F.slice("optPath", 1, k.cast("int")))).alias("rot_ft"),
                    r3(P.path_length(F.col("optPath")) - P.path_length(F.slice("optPath", 1, k.cast("int")))).alias("taxi_ft"))


def q_top_sample(spark, sf):
    o = S.top_sample(optimised(spark, sf))
    return o.select("flight_id", "aircraftType", "slowV", "predictedExit", r6(F.col("optROT")).alias("optROT"),
                    r6(F.col("savings")).alias("savings"))


def q_valid_times(spark, sf):
    return optimised(spark, sf).select("flight_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_nodes": q_scan_nodes, "scan_links": q_scan_links, "edge_src_join": q_edge_src_join,
    "is_exit_link": q_is_exit_link, "exit_edges": q_exit_edges, "link_end_coords": q_link_end_coords,
    "link_by_id": q_link_by_id, "scan_size_classes": q_scan_size_classes, "scan_exit_boxes": q_scan_exit_boxes,
    "airport_code": q_airport_code, "scan_flights": q_scan_flights, "arrivals_only": q_arrivals_only,
    "drop_null_literals": q_drop_null_literals, "min_items": q_min_items, "den_link_patch": q_den_link_patch,
    "touchdown": q_touchdown, "hour_day": q_hour_day, "landing_epoch": q_landing_epoch, "carrier": q_carrier,
    "decel": q_decel, "decel_filter": q_decel_filter, "traffic": q_traffic, "label_real_exit": q_label_real_exit,
    "labelled_only": q_labelled_only, "label_exit_geofence": q_label_exit_geofence,
    "prepare_landings": q_prepare_landings, "select_features": q_select_features,
    "vincenty_m": q_vincenty_m, "pair_speed": q_pair_speed, "consecutive_pairs": q_consecutive_pairs,
    "first_last_of_array": q_first_last_of_array, "flat_angle": q_flat_angle,
    "slow_vertex": q_slow_vertex, "goal_vertex": q_goal_vertex, "avoid_vertex": q_avoid_vertex,
    "planar_link_distance": q_planar_link_distance, "not_adjacent": q_not_adjacent,
    "nearest_exit_end": q_nearest_exit_end, "heuristic_ft": q_heuristic_ft, "best_paths": q_best_paths,
    "opt_path": q_opt_path, "predicted_path": q_predicted_path, "rot_seconds": q_rot_seconds,
    "taxi_seconds": q_taxi_seconds, "valid_times": q_valid_times, "size_class_join": q_size_class_join,
    "cost_rate_lookup": q_cost_rate_lookup, "cost_columns": q_cost_columns, "savings": q_savings,
    "cost_totals": q_cost_totals, "optimise": q_optimise, "mean_measures": q_mean_measures,
    "describe_measures": q_describe_measures, "impact_societal": _impact(S.impact_societal),
    "impact_airline": _impact(S.impact_airline), "time_reduction": _impact(S.time_reduction),
    "distinct_counts": q_distinct_counts, "path_length_sums": q_path_length_sums, "top_sample": q_top_sample,
}


def normalize(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, so result schemas are stable across engines."""
    from pyspark.sql import types as T
    cols = [F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def run(spark: SparkSession, name: str, sf: str) -> DataFrame:
    prepare(spark)
    return normalize(QUERIES[name](spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf, _n=name: run(spark, _n, sf)) for name in QUERIES}


# --- machine learning (rows-only checks: no SQL form) ----------------------------
from runwise.constants import ALL_FEATURES, FOREST_DEPTHS, FOREST_TREES  # noqa: E402
from runwise.operators import model as M  # noqa: E402


def _prepared(spark, sf) -> DataFrame:
    key = (_sid(spark, sf), sf, "prepared")
    if key not in _MEMO:
        _, edges = network(spark, sf)
        _MEMO[key] = materialise(prepare_landings(fx.flights(spark, sf), edges, CODE))
    return _MEMO[key]


def _trained(spark, sf):
    key = (_sid(spark, sf), sf, "model")
    if key not in _MEMO:
        p = _prepared(spark, sf)
        train, test = M.split(p)
        _MEMO[key] = (M.fit_pipeline(p, train, list(ALL_FEATURES), FOREST_TREES[0], FOREST_DEPTHS[0]), train, test)
    return _MEMO[key]


def q_split_counts(spark, sf):
    return M.split_counts(*M.split(_prepared(spark, sf)))


def q_train_test_split(spark, sf):
    """M1: the part of every landing."""
    train, test = M.split(_prepared(spark, sf))
    return train.select("flight_id", F.lit("train").alias("part")).unionByName(test.select("flight_id", F.lit("test").alias("part")))


def q_feature_kinds(spark, sf):
    """M2: kind of each feature, and how many values it has in the landings."""
    p = _prepared(spark, sf)
    kinds = M.feature_kinds(p, list(ALL_FEATURES))
    one = p.agg(*[F.countDistinct(c).alias(c) for c, _ in kinds])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(k).alias("kind"), F.col(c).alias("n_values")) for c, k in kinds])
    return one.select(F.inline(rows))


def q_index_categories(spark, sf):
    return M.index_categories(spark, _trained(spark, sf)[0])


def q_train_forest(spark, sf):
    model, train, test = _trained(spark, sf)
    rf = M.forest(model)
    return spark.createDataFrame([(rf.getNumTrees, rf.getMaxDepth(), rf.numFeatures, rf.numClasses)],
                                 "num_trees int, max_depth int, num_features int, num_classes int")


def q_predict(spark, sf):
    model, train, test = _trained(spark, sf)
    return M.predict(model, test).select("flight_id", "exit", "predictedExit")


def q_accuracy(spark, sf):
    """A6 on the surrogate predictions, which both engines have."""
    _, edges = network(spark, sf)
    p = prepare_landings(fx.flights(spark, sf), edges, CODE, keep=["surrogate_exit"])
    return M.accuracy_of(p, "exit", "surrogate_exit")


def _nodes(spark, sf):
    model, *_ = _trained(spark, sf)
    return M.forest_nodes(spark, model, f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"), model


def q_forest_nodes(spark, sf):
    nodes, _ = _nodes(spark, sf)
    return nodes.select("treeID", "node", "depth", "side", "feature_index", "prediction")


def q_forest_max_depth(spark, sf):
    nodes, _ = _nodes(spark, sf)
    return M.forest_depth(nodes)


def q_node_condition(spark, sf):
    nodes, model = _nodes(spark, sf)
    return M.node_condition(spark, nodes, model)


def q_feature_importances(spark, sf):
    model, *_ = _trained(spark, sf)
    return M.importances(spark, model)


def q_predict_by_nodes(spark, sf):
    """M7 from the node table of M9, beside the model's own prediction."""
    nodes, model = _nodes(spark, sf)
    data = _prepared(spark, sf)
    by_nodes = M.score_by_nodes(materialise(nodes), M.features_of(model, data, ["flight_id"]), M.exit_labels(model))
    own = M.predict(model, data).select("flight_id", "predictedExit")
    both = by_nodes.select("flight_id", F.col("predictedExit").alias("by_nodes")).join(own, "flight_id")
    return both.withColumn("equal", F.col("by_nodes") == F.col("predictedExit"))


def q_importances_by_nodes(spark, sf):
    """M10 from the gains of the node table."""
    nodes, model = _nodes(spark, sf)
    return M.importances_by_nodes(materialise(nodes), M.feature_names(model))


def q_feature_metadata(spark, sf):
    model, *_ = _trained(spark, sf)
    return M.feature_metadata(spark, model)


def q_score_records(spark, sf):
    model, *_ = _trained(spark, sf)
    return M.score(model, _prepared(spark, sf)).select("flight_id", "exit", "predictedExit")


def q_tune_folds(spark, sf):
    key = (_sid(spark, sf), sf, "tune")
    if key not in _MEMO:
        model, train, test = _trained(spark, sf)
        _MEMO[key] = cut_lineage(M.tune_folds(train, list(ALL_FEATURES)))
    return _MEMO[key]


def q_tune(spark, sf):
    return M.best_params(q_tune_folds(spark, sf))


def q_result_document(spark, sf):
    """The result file written and read again: means and number of samples."""
    from runwise.sources import sinks
    o = optimised(spark, sf)
    samples = S.top_sample(o)
    path = f"{ensure_checkpoint_dir(spark)}/result-{uuid.uuid4().hex}"
    sinks.write_result(sinks.result_document(o, samples), path)
    back = sinks.read_result(spark, path, samples)
    return back.select(*[r6(F.col(c)).alias(c) for c in S.MEAN_MEASURES], F.size("samples").alias("n_samples"))


QUERIES.update({
    "train_test_split": q_train_test_split, "feature_kinds": q_feature_kinds, "index_categories": q_index_categories,
    "train_forest": q_train_forest, "predict": q_predict, "accuracy": q_accuracy, "forest_nodes": q_forest_nodes,
    "forest_max_depth": q_forest_max_depth, "node_condition": q_node_condition,
    "feature_importances": q_feature_importances, "sink_feature_json": q_feature_metadata,
    "score_records": q_score_records, "tune": q_tune, "tune_folds": q_tune_folds,
    "predict_by_nodes": q_predict_by_nodes, "importances_by_nodes": q_importances_by_nodes, "sink_result_json": q_result_document,
})


# --- J14 path overlay, F3 / F4 and the run registry ---------------------------------
def q_node_overlay(spark, sf):
    return node_overlay(optimised(spark, sf), network(spark, sf)[0])


def q_path_overlay(spark, sf):
    nodes, edges = network(spark, sf)
    return path_overlay(optimised(spark, sf), nodes, edges)


RUN_ID = f"{CODE}-run"


def _run_root(spark, sf) -> str:
    """The registry of the runs over one folder of tables."""
    return f"{ensure_checkpoint_dir(spark)}/run-registry-{_sid(spark, sf)}"


def _analysis(spark, sf):
    key = (_sid(spark, sf), sf, "analysis")
    if key not in _MEMO:
        from runwise.plans.analysis import run_analysis
        nodes, edges = network(spark, sf)
        _MEMO[key] = (run_analysis(spark, fx.flights(spark, sf), nodes, edges, fx.size_classes(spark, sf), CODE,
                                   _run_root(spark, sf), RUN_ID), RUN_ID)
    return _MEMO[key]


def q_run_analysis(spark, sf):
    out, run_id = _analysis(spark, sf)
    return out["run"].drop("run_duration_ms", "date")


def q_inspect_run(spark, sf):
    """the rows and columns of every result of an inspection."""
    from runwise.plans.analysis import inspect_run
    out, run_id = _analysis(spark, sf)
    every = inspect_run(spark, _run_root(spark, sf), run_id, *network(spark, sf))
    rows = None
    for name, df in every.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("result"), "n_rows", F.lit(",".join(df.columns)).alias("columns"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def q_complete_runs(spark, sf):
    from runwise.sources.sinks import complete_runs
    _analysis(spark, sf)
    return complete_runs(spark, _run_root(spark, sf)).select("run_id", "airport_code").distinct()


def q_list_models(spark, sf):
    from runwise.sources.sinks import list_models
    _analysis(spark, sf)
    return list_models(spark, _run_root(spark, sf))


QUERIES.update({"path_overlay": q_path_overlay, "node_overlay": q_node_overlay, "run_analysis": q_run_analysis, "inspect_run": q_inspect_run,
                "complete_runs": q_complete_runs, "list_models": q_list_models})


# --- inventory items that are stages of the flows above, exposed under their own names ---
def q_prune_columns(spark, sf):
    d = L.prune(L.arrivals(fx.flights_raw(spark, sf, noise=True), CODE), ["flight_id"])
    return d.select("flight_id", "callsign", "runway", "depAirport", "arrAirport", "aircraftType", "arrGate")


def q_promote_header(spark, sf):
    """The header names the columns, in whatever order they are."""
    return read_back(spark, sf).select("callsign", "runway", "depAirport", "arrAirport", "aircraftType", "arrGate")


def q_edge_dst_join(spark, sf):
    _, edges = network(spark, sf)
    return edges.select("link_id", "node_to", "dst")


def q_link_lookup(spark, sf):
    nodes, edges = network(spark, sf)
    d = P.with_link_info(fx.flights(spark, sf), NetworkIndex(nodes, edges))
    d = d.select("flight_id", F.posexplode("_links").alias("idx", "e"))
    return d.select("flight_id", "idx", F.col("e")["src"].alias("src"), F.col("e")["dst"].alias("dst"))


def q_has_slow_vertex(spark, sf):
    v, *_ = _vertices(spark, sf)
    return P.has_slow(v).select("flight_id")


def q_has_goal_vertex(spark, sf):
    v, *_ = _vertices(spark, sf)
    return P.has_goal(v).select("flight_id")


def q_slow_ne_goal(spark, sf):
    v, *_ = _vertices(spark, sf)
    return P.slow_ne_goal(v).select("flight_id")


def q_parse_items(spark, sf):
    t = q_scan_flights(spark, sf)
    return t.select("flight_id", "n_positions", "n_links", "first_link", "last_link")


def q_parse_epoch_ms(spark, sf):
    return q_scan_flights(spark, sf).select("flight_id", "first_epoch", "last_epoch")


def q_path_edges(spark, sf):
    o = optimised(spark, sf)
    d = o.select("flight_id", F.posexplode("optPath").alias("idx", "s"))
    return d.select("flight_id", "idx", F.col("s")["link_id"].alias("link_id"), F.col("s")["length"].alias("length"))


def q_concat_paths(spark, sf):
    o = optimised(spark, sf)
    return o.select("flight_id", _path_text(F.col("predPath")).alias("pred_links"))


def _solved_opt(spark, sf):
    v, nodes, edges, net = _vertices(spark, sf)
    keys = P.drop_adjacent(v, edges).select(F.col("slowV").alias("start"), F.col("goalV").alias("goal"),
                                            F.col("avoidV").alias("avoid"))
    key = (_sid(spark, sf), sf, "solved")
    if key not in _MEMO:
        _MEMO[key] = P.best_paths(keys, nodes, edges)
    return _MEMO[key]


def q_min_cost_vertex(spark, sf):
    """L4: the goal's predecessor chosen by least distance + heuristic."""
    s = _solved_opt(spark, sf)
    return s.select("start", "goal", "avoid", F.get("path", F.size("path") - 1)["from_node"].alias("goal_pred"))


def q_trace_path(spark, sf):
    """Traced vertex sequence start -> goal; NULL when the goal is unreachable."""
    s = _solved_opt(spark, sf)
    nodes = F.concat(F.transform("path", lambda x: x["from_node"]), F.array("goal"))
    return s.select("start", "goal", "avoid", F.when(F.col("path").isNotNull(), F.array_join(nodes, ",")).alias("vertices"))


def q_best_params(spark, sf):
    return q_tune(spark, sf).where("best").select("num_trees", "max_depth")


def q_assemble(spark, sf):
    """M4: feature vectors of all landings, six decimals."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.feature import StringIndexerModel, VectorAssembler
    model, *_ = _trained(spark, sf)
    head = PipelineModel(stages=[s for s in model.stages if isinstance(s, VectorAssembler)
                                 or isinstance(s, StringIndexerModel) and s.getInputCol() != "exit"])
    features = F.transform(vector_to_array("features"), r6)
    return head.transform(_prepared(spark, sf)).select("flight_id", F.posexplode(features).alias("place", "value"))


def q_index_label(spark, sf):
    from pyspark.ml.feature import StringIndexerModel
    model, *_ = _trained(spark, sf)
    lab = next(s for s in model.stages if isinstance(s, StringIndexerModel) and s.getInputCol() == "exit")
    return spark.createDataFrame(list(enumerate(lab.labels)), "label int, exit string")


def q_drop_vector_columns(spark, sf):
    model, train, test = _trained(spark, sf)
    return M.predict(model, test)


def q_sink_describe_csv(spark, sf):
    from runwise.sources.sinks import write_summary
    path = f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    write_summary(optimised(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("summary", *[r6(F.col(c).cast("double")).alias(c) for c in C.MEASURES])


def q_sink_df_csv(spark, sf):
    from runwise.sources.sinks import write_csv
    path = f"{ensure_checkpoint_dir(spark)}/sizes-{uuid.uuid4().hex}"
    write_csv(fx.size_classes(spark, sf), path)
    return spark.read.option("header", True).csv(path)


def q_dropped_rows(spark, sf):
    """How many landings are left after each step, from records to costed landings: the reject ledger, counted once."""
    nodes, edges = network(spark, sf)
    typed = fx.flights(spark, sf).withColumnRenamed("surrogate_exit", "predictedExit")
    return J.left_after(J.by_mask(J.reject_ledger(typed, nodes, edges, CODE)))


def _rejects(spark, sf):
    """The ledger of the packed-text records, noise and malformed numbers included; types are known if they have a size class."""
    nodes, edges = network(spark, sf)
    raw = fx.flights_raw(spark, sf, noise=True, malformed=True, keep=["surrogate_exit"])
    typed = L.parse_flights(raw).withColumnRenamed("surrogate_exit", "predictedExit")
    return J.reject_ledger(typed, nodes, edges, CODE, known={"aircraftType": fx.size_classes(spark, sf).select("ac_type")})


def q_reject_ledger(spark, sf):
    return _rejects(spark, sf).select("flight_id", "reject_mask")


def q_reject_counts(spark, sf):
    return J.by_mask(_rejects(spark, sf))


def q_sink_run_info(spark, sf):
    out, run_id = _analysis(spark, sf)
    run = spark.read.parquet(f"{_run_root(spark, sf)}/runs").where(F.col("run_id") == run_id)
    return run.select("run_id", "airport_code", "num_runways", "num_exits", "train_count", "test_count",
                      F.col("accuracy").between(0, 100).alias("accuracy_is_percent"))


def q_save_model(spark, sf):
    from runwise.sources.sinks import load_model
    out, run_id = _analysis(spark, sf)
    model = load_model(_run_root(spark, sf), run_id)
    return M.predict(model, _prepared(spark, sf)).select("flight_id", "exit", "predictedExit")


def q_scan_run_artifacts(spark, sf):
    from runwise.sources.sinks import read_run
    out, run_id = _analysis(spark, sf)
    every = read_run(spark, _run_root(spark, sf), run_id)
    f = every.pop("features").select("run_id", "featureName", "featureType", F.size("categories").alias("n_categories"))
    # Beside the feature rows: that each other table has rows of the run, as many as its manifest lists.
    said = spark.read.parquet(f"{_run_root(spark, sf)}/manifest").where(F.col("run_id") == run_id)
    for name, df in every.items():
        n = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).join(said.where(F.col("name") == name).select("run_id", "n_rows"), "run_id")
        f = f.unionByName(n.select("run_id", F.lit(name).alias("featureName"), F.lit("table").alias("featureType"),
                                   F.when(F.col("n") == F.col("n_rows"), F.lit(None).cast("int")).otherwise(-1).alias("n_categories")))
    return f


from pyspark.ml import PipelineModel  # noqa: E402

QUERIES.update({
    "prune_columns": q_prune_columns, "promote_header": q_promote_header, "project_vertices": q_scan_nodes,
    "project_edges": q_scan_links, "edge_dst_join": q_edge_dst_join, "link_lookup": q_link_lookup,
    "has_slow_vertex": q_has_slow_vertex, "has_goal_vertex": q_has_goal_vertex, "slow_ne_goal": q_slow_ne_goal,
    "traffic_band_join": q_traffic, "range_frame": q_traffic, "parse_items": q_parse_items,
    "parse_epoch_ms": q_parse_epoch_ms, "path_edges": q_path_edges, "concat_paths": q_concat_paths,
    "min_cost_vertex": q_min_cost_vertex, "trace_path": q_trace_path, "split_counts": q_split_counts,
    "best_params": q_best_params, "assemble": q_assemble, "index_label": q_index_label,
    "drop_vector_columns": q_drop_vector_columns, "sink_describe_csv": q_sink_describe_csv,
    "sink_df_csv": q_sink_df_csv, "sink_run_info": q_sink_run_info, "save_model": q_save_model,
    "scan_run_artifacts": q_scan_run_artifacts, "dropped_rows": q_dropped_rows,
    "reject_ledger": q_reject_ledger, "reject_counts": q_reject_counts,
})
