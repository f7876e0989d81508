from pyspark.sql import Window
from pyspark.sql import functions as F

from runwise.operators.landings import traffic_by_epoch
from runwise.operators.numbering import number_within


def test_number_within_hot_key(spark):
    # one key holds most rows; null keys and orders are numbered too
    hot = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7 % 5000).alias("t"), F.col("id").alias("id"))
    cold = spark.range(600).select((F.col("id") % 30 + 2).alias("k"), F.col("id").alias("t"), (F.col("id") + 10**6).alias("id"))
    odd = spark.createDataFrame([(None, 3, 1), (None, None, 2), (1, None, 3)], "k int, t long, id long")
    df = hot.unionByName(cold).unionByName(odd)
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))).select("id", "rn2").collect()
    got = number_within(df, "k", ["t", "id"], "rn", F.floor(F.col("t") / 100))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        assert sorted((r["id"], r["rn"]) for r in got.select("id", "rn").collect()) == sorted(map(tuple, want))
    spark.conf.unset("spark.sql.exchange.reuse")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_traffic_hot_epoch_collapses(spark):
    # 20000 landings at one instant plus a tail: counts stay exact
    hot = spark.range(20000).select(F.lit(10**12).cast("long").alias("landingEpoch"))
    tail = spark.range(100).select((F.lit(10**12) + F.col("id") * 100000).cast("long").alias("landingEpoch"))
    t = {r[0]: r[1] for r in traffic_by_epoch(hot.unionByName(tail)).collect()}
    assert t[10**12] == 20000 + 9          # itself, the hot copies and tail epochs within +-899999 ms
    assert t[10**12 + 99 * 100000] == 9


def test_hot_link_list_is_no_shuffle_key(spark):
    # a few lists, so most shuffle partitions are empty and adaptive execution keeps to the join that was planned
    from runwise.operators.routes import with_looked_up
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    lists = F.when(F.col("id") < 4000, F.array(F.lit("a"), F.lit("x"))).otherwise(F.array(F.lit("b"), (F.col("id") % 2).cast("string")))
    rows = spark.range(4100).select("id", lists.alias("link_ids")).where("id <> 7")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "link_id string, info int")
    out = with_looked_up(rows, table, "found")
    got = {r["id"]: r["found"] for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 4099 and got[5] == [1, None] and got[4050] == [2, None]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]
    assert "Exchange hashpartitioning(_route" not in plan.split("Initial Plan")[0]
