"""Solved paths kept between runs.

A store is a folder with one table of solved keys per network and stop rule, named by a digest of both, so paths of
another network are never read.  ``solve`` solves only the keys that the table doesn't have, and appends them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwise.session import drop_tables, folder_exists, materialise

KEY = ["start", "goal", "avoid"]


def network_digest(nodes: DataFrame, edges: DataFrame, stop: str) -> str:
    """SHA-256 of the rows that a path depends on, in any order."""
    rows = nodes.select(F.concat_ws("|", F.lit("node"), "node_id", "lat", "long").alias("r")).unionByName(
        edges.select(F.concat_ws("|", F.lit("edge"), "link_id", "src", "dst", "length", "is_exit").alias("r")))
    rows = rows.select(F.sha2("r", 256).alias("r"))
    return rows.agg(F.sha2(F.concat_ws(",", F.lit(stop), F.sort_array(F.collect_list("r"))), 256).alias("d")).first()["d"]


def table_of(store: str, nodes: DataFrame, edges: DataFrame, stop: str) -> str:
    return f"{store.rstrip('/')}/network={network_digest(nodes, edges, stop)}"


def solved_before(spark, folder: str, schema) -> DataFrame:
    """Keys and paths of the store; two runs that solved a key at the same time wrote the same row twice."""
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).dropDuplicates(KEY)


def _same(a: DataFrame, b: DataFrame):
    return (a["start"] == b["start"]) & (a["goal"] == b["goal"]) & a["avoid"].eqNullSafe(b["avoid"])


def solve(keys: DataFrame, nodes: DataFrame, edges: DataFrame, stop: str = "first_touch", store: str | None = None) -> DataFrame:
    """Paths of the keys as ``best_paths`` gives them; with a store, keys that it has are read and new ones added to it."""
    from runwise.operators.paths import best_paths
    keys = keys.select(*KEY).distinct()
    if store is None:
        return best_paths(keys, nodes, edges, stop=stop)
    spark = keys.sparkSession
    folder = table_of(store, nodes, edges, stop)
    keys = materialise(keys)
    schema = ("start string, goal string, avoid string, "
              "path array<struct<link_id:string,from_node:string,is_exit:int,length:double>>")
    old = solved_before(spark, folder, schema)
    new = materialise(keys.join(old, _same(keys, old), "left_anti"))
    if not new.isEmpty():
        solved = best_paths(new, nodes, edges, stop=stop)
        solved.write.mode("append").parquet(folder)
        drop_tables(solved)
    every = solved_before(spark, folder, schema)
    out = materialise(every.join(keys, _same(every, keys), "left_semi"))
    drop_tables(keys, new)
    return out
