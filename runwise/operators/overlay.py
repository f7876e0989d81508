"""The network as drawn for each sampled landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.operators.network import link_coords
from runwise.operators.summary import top_sample
from runwise.session import materialise


def r7(c: Column) -> Column:
    return F.round(c, 7)


def path_overlay(costed: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 50) -> DataFrame:
    """Every link of the network for each sampled landing: on its optimal or predicted path, exit
    flag, end coordinates, and whether it touches the slow vertex."""
    sample = top_sample(costed, n).select("flight_id", "slowV", F.transform("optPath", lambda s: s["link_id"]).alias("opt"),
                                            F.transform("predPath", lambda s: s["link_id"]).alias("pred"))
    sample = materialise(sample)  # at most n rows
    links = link_coords(nodes, edges)
    ids = sample.agg(F.collect_list("flight_id").alias("ids"))
    # The sample's ids (at most n) are one row, which each link is expanded with.
    every = links.join(F.broadcast(ids)).select(F.explode("ids").alias("flight_id"), *[c for c in links.columns if c != "link_order"])
    j = every.join(sample, "flight_id")
    flag = lambda c: F.array_contains(c, F.col("link_id")).cast("bigint")
    return j.select("flight_id", "link_id", flag(F.col("opt")).alias("on_opt"), flag(F.col("pred")).alias("on_pred"),
                    F.col("is_exit").cast("bigint").alias("is_exit"),
                    ((F.col("src") == F.col("slowV")) | (F.col("dst") == F.col("slowV"))).alias("touches_slow"),
                    r7(F.col("src_lat")).alias("src_lat"), r7(F.col("src_long")).alias("src_long"),
                    r7(F.col("dst_lat")).alias("dst_lat"), r7(F.col("dst_long")).alias("dst_long"))


def node_overlay(costed: DataFrame, nodes: DataFrame, n: int = 50) -> DataFrame:
    """Every node of the network for each sampled landing, with ``is_slow``."""
    ids = top_sample(costed, n).agg(F.collect_list(F.struct("flight_id", "slowV")).alias("ids"))
    every = nodes.join(F.broadcast(ids)).select(F.explode("ids").alias("s"), *nodes.columns)
    return every.select("s.flight_id", "node_id", "node_name", r7(F.col("lat")).alias("lat"), r7(F.col("long")).alias("long"),
                        F.coalesce(F.col("node_id") == F.col("s.slowV"), F.lit(False)).alias("is_slow"))
