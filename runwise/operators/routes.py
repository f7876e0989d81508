"""Link lists of landings as a dictionary: each distinct list once, met by a 64-bit id.

Landings share few link lists, so what is looked up per link (J4, J7) is looked up once per list.  Lists travel as a
long: the dictionary is built by one aggregation on it, combined before the shuffle, so a list that a third of all landings
have is one row per task; landings meet it by the long.  Lists whose ids collide are kept apart as variants of the id
and told apart by the list itself, never in a shuffle key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.session import materialise


def route_id(links: str = "link_ids") -> Column:
    return F.xxhash64(links)


def dictionary(df: DataFrame, links: str = "link_ids", id_of=route_id) -> DataFrame:
    """(route_id, variant, link_ids): every distinct list once."""
    lists = df.select(id_of(links).alias("route_id"), F.col(links).alias("link_ids")).groupBy("route_id") \
        .agg(F.sort_array(F.collect_set("link_ids")).alias("lists"))
    return lists.select("route_id", F.posexplode("lists").alias("variant", "link_ids"))


def with_looked_up(df: DataFrame, table: DataFrame, name: str, links: str = "link_ids", id_of=route_id) -> DataFrame:
    """``df`` and ``name``: for each item of the link list what ``table`` (link_id, info) has for it, NULL where nothing.

    An empty list, like a null one, has NULL.
    """
    each = dictionary(df, links, id_of).select("route_id", "variant", F.posexplode("link_ids").alias("at", "link_id"))
    found = each.join(table, "link_id", "left").groupBy("route_id", "variant") \
        .agg(F.sort_array(F.collect_list(F.struct("at", "link_id", "info"))).alias("items"))
    variants = found.groupBy("route_id").agg(F.collect_list(F.struct(
        F.transform("items", lambda x: x["link_id"]).alias("list"), F.transform("items", lambda x: x["info"]).alias("infos"))).alias("_variants"))
    # Written, so that Spark knows how small it is: else landings are shuffled and sorted by the id, where a hot list is one task.
    variants = materialise(variants)
    met = df.withColumn("_route", id_of(links)).join(variants, F.col("_route") == F.col("route_id"), "left")
    mine = F.get(F.filter("_variants", lambda v: v["list"] == F.col(links)), 0)
    return met.select(*df.columns, mine["infos"].alias(name))
