from pyspark.sql import functions as F

from runwise.constants import ALL_FEATURES
from runwise.functions.parse import epoch_ms, item_count
from runwise.operators import landings as L
from runwise.plans import catalog
from runwise.plans.prepare import prepare_landings
from runwise.sources import fixtures as fx


def test_traffic_band(spark):
    df = spark.createDataFrame([(0,), (899999,), (900000,), (1800001,)], "landingEpoch long")
    got = {r[0]: r[1] for r in L.traffic_by_epoch(df).collect()}
    assert got == {0: 2, 899999: 3, 900000: 2, 1800001: 1}


def test_traffic_counts_duplicate_epochs(spark):
    df = spark.createDataFrame([(5,), (5,), (5,), (2000000,)], "landingEpoch long")
    got = sorted(r["traffic"] for r in L.with_traffic(df).collect())
    assert got == [1, 3, 3, 3]


def test_items_rounding_time(spark):
    df = spark.createDataFrame([("a|b||", "1.452135123E12", -0.505, 2.675)], "t string, e string, x double, y double")
    r = df.select(item_count(F.col("t")).alias("n"), epoch_ms(F.col("e")).alias("ms"),
                  F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).first()
    assert (r.n, r.ms, r.x, r.y) == (2, 1452135123000, -0.51, 2.68)
    pos = spark.createDataFrame([([(1.0, 2.0, 1452135123000)],)], "positions array<struct<lat:double,long:double,epoch_ms:bigint>>")
    hd = L.with_hour_day(pos).first()
    assert (hd.hour, hd.day) == ("02", "Thu")
    assert spark.createDataFrame([("AAL123",)], "c string").select(L.carrier(F.col("c"))).first()[0] == "AAL"


def test_traffic_against_all_pairs(spark):
    import random
    rng = random.Random(3)
    at = [rng.randrange(10**12, 10**12 + 30_000_000) for _ in range(300)] + [10**12] * 5
    got = {r[0]: r[1] for r in L.traffic_by_epoch(spark.createDataFrame([(x,) for x in at], "landingEpoch long")).collect()}
    assert got == {x: sum(abs(x - y) < 900000 for y in at) for x in at}


def test_fixture_rows_reach_every_filter(spark, sf):
    fl = fx.flights(spark, sf)
    assert fl.count() == 108 and L.typed_filters(fl, "KPHX").count() < 108
    assert L.decel_filter(L.with_decel(fl)).count() == 89
    sizes = {r[0] for r in fl.select(F.size("positions")).distinct().collect()}
    assert min(sizes) < 6 and max(sizes) > 20


def test_decel_reads_twenty_positions(spark):
    def landing(n, late=0.0):
        return [(33.43, -112.0 + 1e-4 * (k * 5 - k * k / 20) + (late if k > 19 else 0), 10**12 + 2000 * k) for k in range(n)]
    rows = [(1, landing(20)), (2, landing(24, 0.5)), (3, landing(1)), (4, landing(2)), (5, [])]
    df = spark.createDataFrame(rows, "flight_id long, positions array<struct<lat:double,long:double,epoch_ms:bigint>>")
    got = {r["flight_id"]: r["decel"] for r in L.with_decel(df).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] is None and got[5] is None


def test_repeated_records_keep_their_own_links(spark, sf):
    from runwise.operators import paths as P
    from runwise.operators.network import NetworkIndex
    nodes, edges = catalog.network(spark, sf)
    df = spark.createDataFrame([(1, ["1000", "1001"]), (1, ["1000", "1001"]), (1, ["1002", "x", None]), (2, [])], "flight_id long, link_ids array<string>")
    got = sorted((r["flight_id"], [None if x is None else x["src"] for x in r["_links"] or []])
                 for r in P.with_link_info(df, NetworkIndex(nodes, edges)).collect())
    assert got == [(1, ["0", "1"]), (1, ["0", "1"]), (1, ["2", None, None]), (2, [])]


def test_label_exit(spark):
    exits = spark.createDataFrame([("7",), ("9",), ("7",)], "link_id string")
    df = spark.createDataFrame([(1, ["7", "1", "9", "7"]), (1, ["1", "2"]), (1, ["1", "2"]), (2, ["1", "7"])], "flight_id long, link_ids array<string>")
    assert sorted((r["flight_id"], r["exit"] or "") for r in L.label_exit(df, exits).collect()) == [(1, ""), (1, ""), (1, "9"), (2, "7")]


def test_boxes(spark):
    def run(lat, longs):
        return [(lat, x, 1000 * k) for k, x in enumerate(longs)]
    rows = [(1, run(33.4, [-112.00, -112.01, -112.02, -112.03])), (1, run(33.4, [-112.00, -112.001, -112.002, -112.003])), (2, run(33.5, [-112.0, -112.02])),
            (3, [(33.4, -112.0, 0)])]
    df = spark.createDataFrame(rows, "flight_id long, positions array<struct<lat:double,long:double,epoch_ms:bigint>>")
    boxes = spark.createDataFrame([("late", 1, 33.4, -112.031, -112.029), ("early", 2, 33.4, -112.021, -112.019), ("turned", 3, 33.4, -112.0, -112.1)],
                                  "exit_id string, box_order int, lat double, long_upper double, long_lower double")
    got = sorted((r["flight_id"], r["exit"] or "") for r in L.label_exit_by_box(df, boxes).collect())
    assert got == [(1, ""), (1, "early"), (2, ""), (3, "")]
    assert [r["exit_id"] for r in L.check_boxes(boxes).where("NOT usable").collect()] == ["turned"]


def test_preprocessor_intentions(spark, sf):
    """Departures removed, chosen features present, exit column present, no nulls."""
    raw = fx.flights_raw(spark, sf, noise=True)
    kept = L.filter_flights(raw, "KPHX")
    assert kept.where(F.col("arrAirport") != "KPHX").count() == 0
    _, edges = catalog.network(spark, sf)
    p = prepare_landings(L.parse_flights(kept), edges, "KPHX", typed_filters=False)
    assert set(ALL_FEATURES) <= set(p.columns) and "exit" in p.columns
    cols = [c for c in p.columns if c not in ("positions", "link_ids")]
    assert p.where(" OR ".join(f"`{c}` IS NULL" for c in cols)).count() == 0


def test_den_patch_strict_drops_everything(spark, sf):
    raw = fx.flights_raw(spark, sf)
    assert L.den_patch(raw, "KDEN", strict=True).count() == 0
    assert L.den_patch(raw, "KPHX").count() == raw.count()


def test_packed_text_is_parsed_once(spark):
    """The features of landings read the parsed table: no use of a position or link parses the text again."""
    from runwise.plans.prepare import prepare_from_text
    positions = "|".join(f"33.43;{-112.03 + 0.0012 * k - 0.00006 * k * k:.7f};1.{700000000000 + 2000 * k}E12" for k in range(8))
    links = "|".join(f"seg;{k};0;{x}" for k, x in enumerate(["1000", "1001", "1002", "2010", "1035", "1036", "2038"]))
    raw = spark.createDataFrame([(1, "AAL1", "07L", positions, links, "X", "KPHX", "B", "T1")],
                                "flight_id long, callsign string, runway string, positions string, links string, depAirport string, "
                                "arrAirport string, aircraftType string, arrGate string")
    edges = spark.createDataFrame([("2010", 1), ("1000", 0)], "link_id string, is_exit int")
    out = prepare_from_text(raw, edges)
    assert "regexp_replace(" not in out._jdf.queryExecution().optimizedPlan().toString().replace("regexp_replace(callsign", "")
    assert [(r["flight_id"], r["exit"], r["touchdownLat"], len(r["positions"])) for r in out.collect()] == [(1, "2010", 33.43, 8)]
