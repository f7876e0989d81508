from pyspark.sql import functions as F

from runwise.functions.parse import epoch_ms
from runwise.operators import landings as L
from runwise.operators import rejects as J
from runwise.plans import catalog
from runwise.plans.optimise import optimise
from runwise.plans.prepare import prepare_from_text
from runwise.sources import fixtures as fx


def masks(ledger):
    return sorted((r["flight_id"], r["reject_mask"]) for r in ledger.collect())


def test_records_without_a_stopping_bit_are_the_costed_ones(spark, sf):
    nodes, edges = catalog.network(spark, sf)
    raw = fx.flights_raw(spark, sf, noise=True, malformed=True, keep=["surrogate_exit"])
    typed = L.parse_flights(raw).withColumnRenamed("surrogate_exit", "predictedExit")
    ledger = J.reject_ledger(typed, nodes, edges, "KPHX")
    free = {r["flight_id"] for r in ledger.where(J.passes(F.col("reject_mask"))).collect()}
    p = prepare_from_text(raw, edges, "KPHX", keep=["surrogate_exit"]).withColumnRenamed("surrogate_exit", "predictedExit")
    costed = {r["flight_id"] for r in optimise(p, nodes, edges, fx.size_classes(spark, sf), "KPHX").collect()}
    assert free == costed and 0 < len(free) < raw.count()
    # Every record has one row, and malformed numbers are named whether they stop the record or not.
    got = masks(ledger)
    assert [i for i, _ in got] == sorted(r["flight_id"] for r in raw.collect())
    assert all(bool(m & J.bits(["malformed_number"])) == (i % 11 == 3) for i, m in got)


def test_numbers_that_no_long_holds_are_malformed(spark):
    df = spark.createDataFrame([("1.5E3",), ("9.9E99",), ("n/a",), ("1E",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(epoch_ms(F.col("t"))).collect()] == [1500, None, None, None, None, None]


def test_repeated_null_and_unseen_records(spark, sf):
    nodes, edges = catalog.network(spark, sf)
    typed = fx.flights(spark, sf).withColumnRenamed("surrogate_exit", "predictedExit")
    one = typed.orderBy("flight_id").limit(1)
    blank = one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in typed.schema])
    df = one.unionByName(one).unionByName(blank).unionByName(one.withColumn("aircraftType", F.lit("other")).withColumn("arrAirport", F.lit("KLAX")))
    known = {"aircraftType": typed.select("aircraftType"), "runway": typed.select("runway")}
    got = [r["reject_mask"] for r in J.reject_ledger(df, nodes, edges, "KPHX", known=known).collect()]
    alone = [r["reject_mask"] for r in J.reject_ledger(one, nodes, edges, "KPHX", known=known).collect()]
    plain = J.bits(["other_airport", "unseen_category"])
    assert len(got) == 4 and got.count(alone[0]) == 2 and not alone[0] & plain
    assert J.bits(["other_airport", "null_text", "few_items", "unseen_category"]) in got
    assert sum(m & plain == plain and not m & J.bits(["null_text"]) for m in got) == 1


def test_empty_table(spark, sf):
    nodes, edges = catalog.network(spark, sf)
    typed = fx.flights(spark, sf).withColumnRenamed("surrogate_exit", "predictedExit").where("false")
    counted = J.by_mask(J.reject_ledger(typed, nodes, edges, "KPHX"))
    assert counted.count() == 0 and J.left_after(counted).count() == 0


def test_den_links(spark):
    df = spark.createDataFrame([(["10001", "7"],), (["1", "210001"],), ([None],)], "link_ids array<string>")
    cond = J.record_reasons("KDEN")["no_den_link"]
    assert [r[0] for r in df.select(cond).collect()] == [False, True, True] and "no_den_link" not in J.record_reasons("KPHX")
