"""Slow point, goal, avoided vertex and best taxi paths on the taxiway graph.

Vertices of a landing (G1, G2, G4, J10) come from its own link list, of which each distinct one is
joined with the network once.  The path search (G3, ``search``) runs once per distinct
(start, goal, avoid) key - a set bounded by the network, not by the number of landings - and only for the keys
that the store of solved paths (``path_store``) doesn't have.  Results are joined back to the landings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runwise.constants import M_TO_FEET, SLOW_SPEED_MS
from runwise.functions.geo import let, pair_distances, pair_speeds, planar, vincenty
from runwise.operators import path_store, search
from runwise.operators.network import NetworkIndex, link_coords, undirected
from runwise.operators.routes import with_looked_up
from runwise.session import drop_tables, materialise


# --- G1 ---------------------------------------------------------------------
def with_slow_position(df: DataFrame) -> DataFrame:
    """slow_lat / slow_long: second position of the first pair slower than 50 m/s, else the last position."""
    d = df.withColumn("_speeds", pair_speeds(F.col("positions"), pair_distances(F.col("positions"))))
    j = F.array_position(F.transform("_speeds", lambda s: F.coalesce(s < SLOW_SPEED_MS, F.lit(False))), True)
    pos = F.when(j > 0, F.get(F.col("positions"), j.cast("int"))).otherwise(
        F.get(F.col("positions"), F.size("positions") - 1))
    return d.withColumn("_slowpos", pos).withColumn("slow_lat", F.col("_slowpos")["lat"]) \
        .withColumn("slow_long", F.col("_slowpos")["long"]).drop("_speeds", "_slowpos")


def with_link_info(df: DataFrame, net: NetworkIndex) -> DataFrame:
    """_links: the landing's link list resolved against the network (NULL items for unknown links), once per distinct list."""
    return with_looked_up(df, net.link_info(), "_links")


def link_distance(e: Column, lat: Column, long: Column) -> Column:
    """Mean planar (degree) distance of a position to both link ends; 0 when the link is unknown."""
    return F.when(e.isNull(), F.lit(0.0)).otherwise(
        (planar(e["src_lat"], e["src_long"], lat, long) + planar(e["dst_lat"], e["dst_long"], lat, long)) / 2)


def slow_vertex_expr() -> Column:
    """First consecutive link pair with both distances non-zero and the second larger: the shared vertex."""
    links = F.col("_links")
    ds = F.transform(links, lambda e: link_distance(e, F.col("slow_lat"), F.col("slow_long")))

    def with_ds(dd: Column) -> Column:
        n = F.size(dd)
        hit = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda j: F.coalesce(
            (F.get(dd, j) != 0) & (F.get(dd, j + 1) != 0) & (F.get(dd, j + 1) > F.get(dd, j)), F.lit(False)))
        k = F.array_position(hit, True)
        first, second = F.get(links, (k - 1).cast("int")), F.get(links, k.cast("int"))
        shared = F.when((first["src"] == second["src"]) | (first["src"] == second["dst"]), first["src"]) \
            .otherwise(first["dst"])
        return F.when((n >= 2) & (k > 0) & first.isNotNull() & second.isNotNull(), shared)

    return let(ds, with_ds)


# --- G2 ---------------------------------------------------------------------
def goal_vertex_expr() -> Column:
    links = F.col("_links")
    n = F.size(links)
    last, before = F.get(links, n - 1), F.get(links, n - 2)
    in_before = lambda v: (v == before["src"]) | (v == before["dst"])
    return F.when(last.isNotNull() & before.isNotNull() & (n >= 2),
                  F.when(in_before(last["src"]), last["dst"]).when(in_before(last["dst"]), last["src"]))


# --- G4 ---------------------------------------------------------------------
def avoid_vertex_expr(slow: Column) -> Column:
    """Other end of the first link of the landing that touches the slow vertex."""
    e = F.get(F.filter("_links", lambda x: x.isNotNull() & ((x["src"] == slow) | (x["dst"] == slow))), 0)
    return F.when(e.isNotNull(), F.when(e["src"] == slow, e["dst"]).otherwise(e["src"]))


def with_vertices(df: DataFrame, net: NetworkIndex) -> DataFrame:
    """slowV, goalV, avoidV per landing (NULL where the input format uses "none")."""
    d = with_link_info(with_slow_position(df), net)
    d = d.withColumn("slowV", slow_vertex_expr()).withColumn("goalV", goal_vertex_expr())
    d = d.withColumn("avoidV", avoid_vertex_expr(F.col("slowV")))
    return d.drop("_links")


def has_slow(df: DataFrame) -> DataFrame:
    return df.where(F.col("slowV").isNotNull())


def has_goal(df: DataFrame) -> DataFrame:
    return df.where(F.col("goalV").isNotNull())


def slow_ne_goal(df: DataFrame) -> DataFrame:
    return df.where(F.col("slowV") != F.col("goalV"))


def drop_adjacent(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep rows with both vertices, slowV != goalV and no edge between them."""
    u = undirected(edges).select(F.col("a").alias("slowV"), F.col("b").alias("goalV")).distinct()
    d = slow_ne_goal(has_goal(has_slow(df)))
    return d.join(u, ["slowV", "goalV"], "left_anti")


# --- J10 --------------------------------------------------------------------
def exit_ends(pairs: DataFrame, net: NetworkIndex, exit_col: str = "predictedExit") -> DataFrame:
    """near / far / exit_length for distinct (slowV, exit) pairs (a set bounded by the network)."""
    info = net.link_info().select(F.col("link_id").alias(exit_col), "info")
    xy = net.nodes.select(F.col("node_id").alias("slowV"), F.col("lat").alias("_sa"), F.col("long").alias("_so"))
    d = pairs.join(info, exit_col, "left").join(xy, "slowV", "left")
    e = F.col("info")
    d = d.select("slowV", exit_col, e["src"].alias("_es"), e["dst"].alias("_ed"), e["length"].alias("exit_length"),
                 e["src_lat"].alias("_a1"), e["src_long"].alias("_o1"), e["dst_lat"].alias("_a2"),
                 e["dst_long"].alias("_o2"), "_sa", "_so")
    d = d.withColumn("_ds", vincenty(F.col("_sa"), F.col("_so"), F.col("_a1"), F.col("_o1"))) \
        .withColumn("_dd", vincenty(F.col("_sa"), F.col("_so"), F.col("_a2"), F.col("_o2")))
    src_near = F.col("_ds") < F.col("_dd")
    ok = F.col("_es").isNotNull() & F.col("_sa").isNotNull()
    return d.select("slowV", exit_col,
                    F.when(ok, F.when(src_near, F.col("_es")).otherwise(F.col("_ed"))).alias("near"),
                    F.when(ok, F.when(src_near, F.col("_ed")).otherwise(F.col("_es"))).alias("far"),
                    F.when(ok, F.col("exit_length")).alias("exit_length"))


def with_exit_ends(df: DataFrame, net: NetworkIndex, exit_col: str = "predictedExit") -> DataFrame:
    """near / far: ends of the predicted exit link nearer to / farther from slowV (tie: dst is near).

    The geodesic runs once per distinct (slowV, exit) pair, not per landing; the
    small result is written, so Spark knows its size and landings aren't shuffled by these few pairs.
    """
    pairs = df.select("slowV", exit_col).where(F.col("slowV").isNotNull() & F.col(exit_col).isNotNull()).distinct()
    return df.join(materialise(exit_ends(pairs, net, exit_col)), ["slowV", exit_col], "left")


# --- G3 ---------------------------------------------------------------------
def effective_avoid(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """avoid_eff: the avoided vertex unless start == avoid or start and goal are adjacent."""
    adj = undirected(edges).select(F.col("a").alias("start"), F.col("b").alias("goal")).distinct().withColumn("_adj", F.lit(True))
    k = keys.join(adj, ["start", "goal"], "left")
    return k.withColumn("avoid_eff", F.when(F.col("_adj").isNull() & (F.col("start") != F.coalesce(F.col("avoid"), F.lit(""))),
                                             F.col("avoid"))).drop("_adj")


def path_length(path: Column) -> Column:
    """Left-to-right sum of step lengths (the order a search accumulates them in)."""
    return F.aggregate(path, F.lit(0.0), lambda acc, s: acc + s["length"])


def check_heuristic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges shorter than the geodesic between their ends: with one of them the heuristic isn't consistent."""
    c = link_coords(nodes, edges)
    d = c.withColumn("geodesic_ft", vincenty(F.col("src_lat"), F.col("src_long"), F.col("dst_lat"), F.col("dst_long")) * M_TO_FEET)
    return d.where(F.col("length") < F.col("geodesic_ft") * (1 - 1e-12)).select("link_id", "length", "geodesic_ft")


def heuristic(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """h: geodesic in feet for the (node, goal) rows."""
    xy = nodes.select("node_id", "lat", "long")
    at = xy.select(F.col("node_id").alias("node"), F.col("lat").alias("_a"), F.col("long").alias("_o"))
    to = xy.select(F.col("node_id").alias("goal"), F.col("lat").alias("_ga"), F.col("long").alias("_go"))
    d = pairs.join(at, "node").join(to, "goal")
    return d.select(*pairs.columns, (vincenty(F.col("_a"), F.col("_o"), F.col("_ga"), F.col("_go")) * M_TO_FEET).alias("h"))


def best_paths(keys: DataFrame, nodes: DataFrame, edges: DataFrame, stop: str = "first_touch") -> DataFrame:
    """Paths for distinct (start, goal, avoid) keys.

    stop='first_touch': the answer of a best-first search that stops as soon as the popped vertex touches the goal.
    If no link is shorter than its geodesic the heuristic is consistent and this is the shortest way start->u in the
    graph without the avoided vertex and the goal, for the neighbour u of the goal with the least distance + heuristic
    (ties: smaller u), then u->goal by its shortest link.  With shorter links the order of the pops decides, and the
    search is run as such, in bands (``search.ordered_first_touch``).
    Of ways of equal length it is the one over vertices that the search pops first.
    stop='exact': shortest path start->goal in the graph without the avoided vertex; equal lengths are broken by the
    smaller vertex and link before, from the end on.

    Returns (start, goal, avoid, path array<struct<link_id, from_node, is_exit, length>>);
    path is NULL when the goal cannot be reached, is the avoided vertex, or start == goal.
    """
    k = effective_avoid(keys.select("start", "goal", "avoid").distinct(), edges)
    k = materialise(k.withColumn("kid", F.monotonically_increasing_id()))  # written once, so the ids stay
    und = materialise(search.with_cost(undirected(edges).select("a", "b", "link_id", "length", "is_exit")))
    # A goal that is the avoided vertex has no path.
    open_k = k.where((F.col("start") != F.col("goal")) & ~F.col("goal").eqNullSafe(F.col("avoid"))).drop("avoid")
    if stop == "exact":
        found = search.shortest(open_k, und, through_goal=True)
        reach = search.predecessors(found, open_k, und)
        drop_tables(found)
        done = search.trace(reach, open_k.select("kid", F.col("goal").alias("node")).join(reach, ["kid", "node"], "left_semi"))
        done = done.select("kid", "path")
    else:
        touching = und.select(F.col("a").alias("node"), F.col("b").alias("goal"), "length", "link_id", "is_exit")
        last = touching.groupBy("node", "goal").agg(F.min(F.struct("length", "link_id", "is_exit")).alias("_e"))
        if check_heuristic(nodes, edges).isEmpty():
            found = search.shortest(open_k, und, through_goal=False)
            reach = search.predecessors(found, open_k, und, lambda rows: heuristic(rows, nodes))
            drop_tables(found)
            near = reach.select("kid", "node", "g").join(open_k.select("kid", "goal"), "kid").join(last.select("node", "goal"), ["node", "goal"])
            near = heuristic(near, nodes).groupBy("kid").agg(F.min(F.struct((F.col("g") + F.col("h")).alias("f"), F.col("node"))).alias("_b"))
            ends = materialise(near.select("kid", F.col("_b.node").alias("node")))
        else:
            reach, ends = search.ordered_first_touch(open_k, und, lambda rows: heuristic(rows, nodes))
        done = search.trace(reach, ends).join(open_k.select("kid", "goal"), "kid").join(last, ["node", "goal"])
        step = F.struct(F.col("_e.link_id"), F.col("node").alias("from_node"), F.col("_e.is_exit"), F.col("_e.length"))
        done = done.select("kid", F.concat("path", F.array(step)).alias("path"))
    out = materialise(k.join(done, "kid", "left").select("start", "goal", "avoid", "path"))
    drop_tables(k, und, reach)
    return out


# --- G5 / G6 ----------------------------------------------------------------
def flag_path(path: Column, slow: Column, slow_on_exit: Column) -> Column:
    """(link_id, is_exit, length) steps; the flag is forced to 1 on an edge leaving slowV when slowV is on an exit edge."""
    return F.transform(path, lambda s: F.struct(
        s["link_id"].alias("link_id"),
        F.when((s["from_node"] == slow) & slow_on_exit, F.lit(1)).otherwise(s["is_exit"]).cast("int").alias("is_exit"),
        s["length"].alias("length")))


def with_paths(df: DataFrame, nodes: DataFrame, edges: DataFrame, net: NetworkIndex,
               exit_col: str = "predictedExit", stop: str = "first_touch", drop: bool = True, store: str | None = None) -> DataFrame:
    """optPath (slowV -> goalV) and predPath (slowV -> near ++ exit ++ far -> goalV).

    Rows without either path drop, or are kept with ``has_paths`` false."""
    # read once for the key set and three times for the joins back
    d = materialise(with_exit_ends(df, net, exit_col))
    opt_k = d.select(F.col("slowV").alias("start"), F.col("goalV").alias("goal"), F.col("avoidV").alias("avoid"))
    leg1_k = d.where(F.col("slowV") != F.col("near")).select(
        F.col("slowV").alias("start"), F.col("near").alias("goal"), F.col("avoidV").alias("avoid"))
    leg2_k = d.where(F.col("far").isNotNull()).select(
        F.col("far").alias("start"), F.col("goalV").alias("goal"), F.col("avoidV").alias("avoid"))
    keys = opt_k.unionByName(leg1_k).unionByName(leg2_k).distinct()
    solved = path_store.solve(keys, nodes, edges, stop=stop, store=store)

    def attach(frame: DataFrame, start: str, goal: str, name: str) -> DataFrame:
        s = solved.select(F.col("start").alias("_s"), F.col("goal").alias("_g"), F.col("avoid").alias("_a"),
                          F.col("path").alias(name))
        cond = (frame[start] == s["_s"]) & (frame[goal] == s["_g"]) & frame["avoidV"].eqNullSafe(s["_a"])
        return frame.join(s, cond, "left").drop("_s", "_g", "_a")

    d = attach(d, "slowV", "goalV", "_opt")
    d = attach(d, "slowV", "near", "_leg1")
    d = attach(d, "far", "goalV", "_leg2")
    d = d.join(net.exit_node_df.select(F.col("node").alias("slowV"), F.lit(True).alias("_slow_on_exit")), "slowV", "left")
    slow_on_exit = F.coalesce(F.col("_slow_on_exit"), F.lit(False))
    leg1_ok = (F.col("slowV") == F.col("near")) | F.col("_leg1").isNotNull()
    exit_step = F.array(F.struct(F.col(exit_col).alias("link_id"), F.lit(1).alias("is_exit"),
                                 F.col("exit_length").alias("length")))
    leg1 = F.when(F.col("slowV") == F.col("near"), F.array().cast(f"array<{PATH_T}>")) \
        .otherwise(flag_path(F.col("_leg1"), F.col("slowV"), slow_on_exit))
    pred = F.concat(leg1, exit_step, flag_path(F.col("_leg2"), F.col("slowV"), slow_on_exit))
    d = d.withColumn("has_paths", F.coalesce(F.col("_opt").isNotNull() & leg1_ok & F.col("_leg2").isNotNull() & F.col("near").isNotNull(),
                                             F.lit(False)))
    if drop:
        d = d.where("has_paths").drop("has_paths")
    return d.withColumn("optPath", flag_path(F.col("_opt"), F.col("slowV"), slow_on_exit)) \
        .withColumn("predPath", pred).drop("_opt", "_leg1", "_leg2", "_slow_on_exit")


PATH_T = "struct<link_id:string,is_exit:int,length:double>"
