from pyspark.sql import functions as F

from runwise.operators.network import NetworkIndex, clean_network, is_exit

# Names made up so that each branch of the two name patterns is met.
EXITS = ["A.n1_08/26.1", "08L/26R.3_A.n3", "T1.4_07L/25R.4", "C.n2_07R/25L.n2", "Gate way (4)_08/26.12"]
NOT_EXITS = ["07L/25R.3_07L/25R.4", "08/26.1_08/26.2", "A.n1_A.n2", "T1.4_T2.4", "", "07R/25L.n1_07R/25L.n2"]


def test_exit_patterns(spark):
    df = spark.createDataFrame([(n,) for n in EXITS + NOT_EXITS], "name string")
    flags = {r["name"]: r["x"] for r in df.select("name", is_exit(F.col("name")).alias("x")).collect()}
    assert [flags[n] for n in EXITS] == [1] * len(EXITS) and [flags[n] for n in NOT_EXITS] == [0] * len(NOT_EXITS)


def test_first_row_of_a_link_id_wins(spark):
    nodes = spark.createDataFrame([(str(k), f"n{k}", float(k), 0.0) for k in range(5)], "nodeID string, nodeName string, latitude double, longitude double")
    links = spark.createDataFrame([("7", "a", "n3", "n4", 1.0, 0), ("7", "b", "n0", "n1", 2.0, 1), ("8", "c", "n1", "n2", 3.0, 2)],
                                  "LinkID string, LinkName string, NodeNameFrom string, NodeNameTo string, Length double, row_order int")
    net = NetworkIndex(*clean_network(nodes, links))
    got = {r["link_id"]: (r["info"]["src"], r["info"]["dst"]) for r in net.link_info().collect()}
    assert got == {"7": ("3", "4"), "8": ("1", "2")}


def test_fixture_network(spark, sf):
    from runwise.plans import catalog
    nodes, edges = catalog.network(spark, sf)
    assert nodes.count() == 125 and edges.count() == 203
    ex = {r.link_name: r.is_exit for r in edges.collect()}
    assert ex["T1.4_07L/25R.4"] == 1 and ex["07L/25R.3_07L/25R.4"] == 0
    assert sum(ex.values()) == 8
