import os
import tempfile

import pytest

from runwise.operators import landings as L
from runwise.operators.network import clean_network
from runwise.sources import fixtures as fx
from runwise.sources import readers as R


def test_csv_round_trip(spark, sf):
    d = tempfile.mkdtemp(prefix="runwise-test-", dir=os.environ.get("RUNWISE_SCRATCH", "/tmp"))
    raw = fx.flights_raw(spark, sf)
    raw.select(*R.FLIGHT_COLUMNS).write.option("header", True).csv(f"{d}/flights")
    back = R.read_flights(spark, f"{d}/flights/*.csv")
    assert back.count() == raw.count()
    assert L.parse_flights(L.filter_flights(back, "KPHX")).count() == L.typed_filters(fx.flights(spark, sf), "KPHX").count()
    fx.raw_nodes(spark, sf).selectExpr("nodeID AS NodeID", "'PHX' AS AirportCode", "nodeName AS NodeName",
                                       "latitude AS Latitude", "longitude AS Longitude", "'0' AS Diameter",
                                       "'1' AS NodeTypeID", "'null' AS RunwayAssociation", "'0' AS SpotFlag") \
        .write.option("header", True).csv(f"{d}/nodes")
    fx.raw_links(spark, sf).selectExpr("LinkID", "LinkName", "'PHX' AS AirportCode", "NodeNameFrom", "NodeNameTo",
                                       "Length", "'20' AS MaxSpeed", "'200' AS MinimumAircraftSeparationDistance",
                                       "'10' AS LinkTypeID", "'null' AS RunwayAssociation") \
        .write.option("header", True).csv(f"{d}/links")
    nodes, edges = clean_network(R.read_nodes(spark, f"{d}/nodes"), R.read_links(spark, f"{d}/links"))
    assert nodes.count() == 125 and edges.count() == 203 and edges.where("is_exit = 1").count() == 8


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("runway,extra,callsign,positions,links,depAirport,arrAirport,aircraftType,arrGate\n07L,z,AAL1,1;2;1E3,a;b;c;5,KLAX,KPHX,B738,T1\n")
    row = R.read_flights(spark, f"file://{tmp_path}/a.csv").first()
    assert (row["callsign"], row["runway"], row["arrGate"]) == ("AAL1", "07L", "T1") and "extra" not in row
    (tmp_path / "b.csv").write_text("runway,callsign\n07L,AAL1\n")
    with pytest.raises(ValueError, match="positions"):
        R.read_flights(spark, f"file://{tmp_path}/b.csv")
    (tmp_path / "sizes.csv").write_text("Category,ACTypes\nLarge,B738\nGA,B738\n")
    assert R.read_size_classes(spark, f"file://{tmp_path}/sizes.csv").first()["category"] == "Large"
    (tmp_path / "boxes.csv").write_text("lat,longLower,longUpper,exitID\n33.1,-112.1,-112.2,B7\n")
    box = R.read_exit_boxes(spark, f"file://{tmp_path}/boxes.csv").first()
    assert (box["exit_id"], box["box_order"], box["lat"], box["long_upper"], box["long_lower"]) == ("B7", 1, 33.1, -112.2, -112.1)


def test_reruns_replace_a_run(spark, tmp_path):
    from runwise.sources import sinks
    root = f"file://{tmp_path}/runs"
    meta = lambda n: spark.createDataFrame([(n, "continuous", None)], "featureName string, featureType string, categories array<string>")
    sinks.write_features(meta("a"), root, "r1")
    sinks.write_features(meta("b"), root, "r2")
    sinks.write_features(meta("c"), root, "r1")
    assert sorted((r["run_id"], r["featureName"]) for r in spark.read.parquet(f"{root}/features").collect()) == [("r1", "c"), ("r2", "b")]
