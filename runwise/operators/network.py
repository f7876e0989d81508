"""Taxiway network: vertices, edges, exit flags, lookups.

The network of one airport is a dimension table (hundreds to a few thousand links).  It is
written once, so Spark knows its size in bytes and itself chooses how to join it; there is one
way for networks of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.constants import EXIT_LINK_PATTERN, RUNWAY_LINK_PATTERN
from runwise.session import materialise


def is_exit(name: Column) -> Column:
    """1 when a link name finds the exit pattern and not the runway pattern, else 0."""
    return F.when(name.rlike(RUNWAY_LINK_PATTERN), F.lit(0)) \
        .when(name.rlike(EXIT_LINK_PATTERN), F.lit(1)).otherwise(F.lit(0)).cast("int")


def project_vertices(raw_nodes: DataFrame) -> DataFrame:
    """nodeID, nodeName, latitude, longitude -> typed node table."""
    return raw_nodes.select(
        F.col("nodeID").cast("string").alias("node_id"), F.col("nodeName").cast("string").alias("node_name"),
        F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("long"))


def project_edges(raw_links: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """LinkID, LinkName, NodeNameFrom, NodeNameTo, Length -> typed link table (length in feet)."""
    return raw_links.select(
        *(keep or []),
        F.col("LinkID").cast("string").alias("link_id"), F.col("LinkName").cast("string").alias("link_name"),
        F.col("NodeNameFrom").cast("string").alias("node_from"), F.col("NodeNameTo").cast("string").alias("node_to"),
        F.col("Length").cast("double").alias("length"))


def clean_network(raw_nodes: DataFrame, raw_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges with src / dst node ids (inner joins on node names) and exit flags."""
    nodes = project_vertices(raw_nodes)
    # The order of the link table decides between rows with the same link id.
    order = F.col("row_order") if "row_order" in raw_links.columns else F.monotonically_increasing_id()
    links = project_edges(raw_links.withColumn("_order", order), ["_order"]).withColumnRenamed("_order", "link_order")
    by_name = nodes.select("node_name", "node_id")
    src = by_name.select(F.col("node_name").alias("node_from"), F.col("node_id").alias("src"))
    dst = by_name.select(F.col("node_name").alias("node_to"), F.col("node_id").alias("dst"))
    edges = links.join(src, "node_from", "inner").join(dst, "node_to", "inner")
    edges = edges.select("link_id", "link_name", "node_from", "node_to", "length", "src", "dst",
                         is_exit(F.col("link_name")).alias("is_exit"), "link_order")
    return nodes, edges


def exit_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("is_exit") == 1)


def link_coords(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each link with the coordinates of both end vertices."""
    n = nodes
    a = n.select(F.col("node_id").alias("src"), F.col("lat").alias("src_lat"), F.col("long").alias("src_long"))
    b = n.select(F.col("node_id").alias("dst"), F.col("lat").alias("dst_lat"), F.col("long").alias("dst_long"))
    return edges.join(a, "src", "inner").join(b, "dst", "inner").select(
        "link_id", "link_name", "src", "dst", "length", "is_exit", "src_lat", "src_long", "dst_lat", "dst_long",
        *([c for c in ("link_order",) if c in edges.columns]))


def link_by_id(nodes: DataFrame, edges: DataFrame, link_id: str) -> DataFrame:
    return link_coords(nodes, edges).where(F.col("link_id") == link_id)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (a, b, link_id, length, is_exit)."""
    fwd = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "link_id", "length", "is_exit")
    rev = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "link_id", "length", "is_exit")
    return fwd.unionByName(rev)


class NetworkIndex:
    """The tables that per-landing steps join with, each written once."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes
        self.coords = link_coords(nodes, edges)
        self.exit_node_df = materialise(exit_edges(edges).select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        info = F.struct("src", "dst", "length", "is_exit", "src_lat", "src_long", "dst_lat", "dst_long")
        order = "link_order" if "link_order" in self.coords.columns else "link_id"
        self._links = materialise(self.coords.groupBy("link_id").agg(F.min_by(info, F.struct(order, info)).alias("info")))

    def link_info(self) -> DataFrame:
        """(link_id, info struct): the first row of the link table for each link id."""
        return self._links
