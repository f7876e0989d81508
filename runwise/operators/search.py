"""Path search on the taxiway graph as DataFrame jobs: semi-naive relaxation, ordered search, pointer doubling.

All three work on search keys (kid, start, goal, avoid_eff), a set bounded by the network, and on
the undirected edges (a, b, link_id, length, is_exit).  What is known of a vertex is one row

    kid, node, g (distance), from_node, link_id, is_exit, length      -- the last four: the edge it is reached by

and never a path.  Paths are traced at the end, for the vertices that are asked for only.  A link of no length counts as
``LEAST_FT`` in distances, so a way never comes back to a vertex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runwise.session import counted, drop_tables, materialise

EDGE = ["from_node", "link_id", "is_exit", "length"]
NO_VERTEX = ""
LEAST_FT = 1e-6


def with_cost(und: DataFrame) -> DataFrame:
    """Undirected edges with ``cost``: the length as it counts in distances."""
    return und.withColumn("cost", F.greatest(F.col("length"), F.lit(LEAST_FT)))


# --- G3: shortest distances ----------------------------------------------------
def shortest(keys: DataFrame, und: DataFrame, through_goal: bool, steps: int = 8) -> DataFrame:
    """(kid, node, g): least distance of every vertex that a key's start reaches without its avoided vertex.

    Semi-naive: a round extends only the rows that the round before has improved, by up to ``steps`` edges, and
    writes only the rows that are new or better than the known ones, so what a round writes shrinks with the frontier.
    The known rows are the union of those small tables, read once a round and dealt by key; all steps of a round then
    join with the edges and aggregate without another shuffle.  ``through_goal`` false: the goal is no vertex of any way.
    """
    spark = keys.sparkSession
    # A vertex is also its own neighbour by no edge: a step keeps what is known.
    edges = materialise(und.select("a", "b", "cost").unionByName(und.select("a", F.col("a").alias("b")).distinct(), allowMissingColumns=True))
    rim = keys.select("kid", F.col("start").alias("node"), F.lit(0.0).alias("g"), "goal", F.coalesce("avoid_eff", F.lit(NO_VERTEX)).alias("avoid"))
    rounds = [materialise(rim.withColumn("round", F.lit(0)))]
    open_ = "node <> goal" if through_goal else "b <> goal"
    # ``old``: the known distance, ``g``: the least one of this round; only better ones and those of the last round go on.
    step = """SELECT kid, b AS node, goal, avoid, min(if(cost IS NULL, g, g + cost)) AS g, min(if(cost IS NULL, old, NULL)) AS old, false AS fresh
              FROM ({before}) JOIN {{edges}} ON node = a
              WHERE cost IS NULL OR (fresh OR old IS NULL OR g < old) AND b <> avoid AND """ + open_ + """ GROUP BY kid, b, goal, avoid"""
    while True:  # a shortest way has fewer edges than there are vertices, so some round improves nothing
        last = len(rounds) - 1
        plan = f"""SELECT kid, node, goal, avoid, min(g) AS g, min(g) AS old, min_by(round, g) = {last} AS fresh
                   FROM (SELECT /*+ REPARTITION(kid) */ * FROM {{known}}) GROUP BY kid, node, goal, avoid"""
        for _ in range(steps):
            plan = step.format(before=plan)
        new = spark.sql(f"SELECT kid, node, g, goal, avoid, {last + 1} AS round FROM ({plan}) WHERE old IS NULL OR g < old".replace("{{", "{").replace("}}", "}"),
                        known=_union(rounds), edges=edges)
        new, n = counted(new)
        if n == 0:
            out = materialise(_union(rounds).groupBy("kid", "node").agg(F.min("g").alias("g")))
            drop_tables(edges, new, *rounds)
            return out
        rounds.append(new)


def predecessors(reach: DataFrame, keys: DataFrame, und: DataFrame, with_h: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Reach rows with the edge each vertex is reached by, of those that give its distance.

    With a heuristic it is the edge from the vertex of least f = g + h (then the smaller vertex, the smaller link): the one that a
    best-first search pops first.  Without, it is the edge from the smaller vertex, then the smaller link.
    """
    at = reach.join(keys.select("kid", "start", "goal"), "kid")
    at = with_h(at).withColumn("f", F.col("g") + F.col("h")) if with_h else at.withColumn("f", F.lit(0.0))
    near = und.select(F.col("a").alias("node"), F.col("b").alias("to"), "link_id", "is_exit", "length", "cost")
    ways = at.join(near, "node").select("kid", "to", (F.col("g") + F.col("cost")).alias("to_g"),
                                        F.struct("f", F.col("node").alias("from_node"), "link_id", "is_exit", "length").alias("way"))
    ends = reach.select("kid", F.col("node").alias("to"), F.col("g").alias("to_g"))
    best = ends.join(ways, ["kid", "to", "to_g"]).groupBy("kid", F.col("to").alias("node"), F.col("to_g").alias("g")).agg(F.min("way").alias("w"))
    first = at.where("node = start").select("kid", "node", "g", *[F.lit(None).cast(t).alias(c) for c, t in zip(EDGE, ("string", "string", "int", "double"))])
    return materialise(first.unionByName(best.select("kid", "node", "g", *[F.col(f"w.{c}").alias(c) for c in EDGE])))


def _union(frames: list[DataFrame]) -> DataFrame:
    """One scan over all the tables of the rounds."""
    if len(frames) == 1:
        return frames[0]
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*[f.written_to for f in frames])


# --- 2.7.1 without a consistent heuristic: ordered search -------------------------
def ordered_first_touch(keys: DataFrame, und: DataFrame, with_h: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The early-stopping best-first search for any heuristic, all keys at once.

    ``with_h`` adds the heuristic h to rows with node and goal.

    The search pops the open vertex of least f = g + h (ties: smaller vertex), relaxes its neighbours, popped ones
    included, never opens a vertex twice, and stops when a popped vertex touches the goal.  A round pops a whole band
    of the queue: the vertices before which nothing that is popped puts a vertex of smaller or equal f, so popping them
    together is popping them one by one.  Keys leave when they touch their goal or have no open vertex.

    Returns the reach rows as they are when each key stops, and (kid, node): the vertex that touched the goal.
    """
    rim = materialise(keys.select("kid", "goal", F.coalesce("avoid_eff", F.lit(NO_VERTEX)).alias("avoid")))
    by_queue = Window.partitionBy("kid").orderBy("f", "node")
    earlier = by_queue.rowsBetween(Window.unboundedPreceding, -1)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in zip(EDGE, ("string", "string", "int", "double"))]
    first = keys.select("kid", F.col("start").alias("node"), "goal", F.lit(0.0).alias("g"), *nothing)
    state = materialise(with_h(first).drop("goal").withColumn("popped", F.lit(False)))
    settled, touched = [], []
    while True:
        open_ = state.where("NOT popped").join(rim, "kid")
        queue = open_.select("kid", "node", "goal", "avoid", "g", (F.col("g") + F.col("h")).alias("f"))
        near = queue.join(und, F.col("node") == F.col("a")).where((F.col("b") != F.col("avoid")))
        # What each open vertex would give its neighbours, popped now.
        gives = near.where(F.col("b") != F.col("goal")).select(
            "kid", "node", "goal", F.col("b").alias("to"), (F.col("g") + F.col("cost")).alias("to_g"), "link_id", "is_exit", "length")
        old = state.select("kid", F.col("node").alias("to"), F.col("g").alias("old_g"), "popped")
        gains = gives.join(old, ["kid", "to"], "left").where("old_g IS NULL OR to_g < old_g")
        gains = with_h(gains.withColumnsRenamed({"node": "by", "to": "node"}))
        gains = materialise(gains.withColumnsRenamed({"node": "to", "by": "node", "h": "to_h"}).drop("goal"))
        opens = gains.where("popped IS NULL OR NOT popped").groupBy("kid", "node").agg(F.min(F.col("to_g") + F.col("to_h")).alias("opens_f"))
        touches = near.where(F.col("b") == F.col("goal")).select("kid", "node").distinct().withColumn("touch", F.lit(True))
        line = queue.join(opens, ["kid", "node"], "left").join(touches, ["kid", "node"], "left")
        before = F.min("opens_f").over(earlier)
        band = line.withColumn("safe", before.isNull() | (F.col("f") < before)) \
            .withColumn("after_touch", F.coalesce(F.max("touch").over(earlier), F.lit(False)))
        # Unsafe once, unsafe from there on.
        band = band.withColumn("cut", F.coalesce(F.max(~F.col("safe")).over(earlier), F.lit(False)) | ~F.col("safe") | F.col("after_touch"))
        band, n = counted(band.where("NOT cut").select("kid", "node", F.row_number().over(by_queue).alias("rank"),
                                                       F.coalesce("touch", F.lit(False)).alias("touch")))
        if n == 0:
            settled.append(state)
            drop_tables(gains, band)
            break
        # Of equal distances the vertex popped first gives the edge: a later one isn't less.
        given = gains.join(band.select("kid", "node", "rank"), ["kid", "node"])
        given = given.groupBy("kid", "to").agg(F.min(F.struct("to_g", "rank", "length", "link_id", "is_exit", "node", "to_h")).alias("w"))
        given = given.select("kid", F.col("to").alias("node"), F.col("w.to_g").alias("n_g"),
                             F.col("w.node").alias("n_from_node"), F.col("w.link_id").alias("n_link_id"), F.col("w.is_exit").alias("n_is_exit"),
                             F.col("w.length").alias("n_length"), F.col("w.to_h").alias("n_h"))
        now = state.join(band.select("kid", "node", F.lit(True).alias("pops")), ["kid", "node"], "left")
        now = now.join(given, ["kid", "node"], "full")
        new = F.col("n_g").isNotNull()
        now = now.select("kid", "node", *[F.when(new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ["g", *EDGE, "h"]],
                         (F.coalesce("popped", F.lit(False)) | F.coalesce("pops", F.lit(False))).alias("popped"))
        hits = materialise(band.where("touch").select("kid", "node"))
        goes_on = band.groupBy("kid").agg(F.max("touch").alias("touch")).where("NOT touch").select("kid")
        now = materialise(now)
        done = materialise(now.join(goes_on, "kid", "left_anti"))
        rest = materialise(now.join(goes_on, "kid", "left_semi"))
        settled.append(done)
        touched.append(hits)
        drop_tables(gains, band, now, state)
        state = rest
    reach = materialise(_union(settled).drop("popped", "h"))
    ends = materialise(_union(touched)) if touched else rim.select("kid", F.lit(None).cast("string").alias("node")).where("false")
    drop_tables(*settled, *touched, *([rim] if touched else []))
    return reach, ends


# --- G8: tracing ---------------------------------------------------------------
def trace(reach: DataFrame, ends: DataFrame) -> DataFrame:
    """Paths from the start to the vertices of ``ends`` (kid, node), by pointer doubling over the reached edges.

    J0 leads a vertex to the one before it, J(k+1) is J(k) twice, as many as the longest way's number of edges has binary digits.
    From the highest down, every vertex already on a path marks the one 2^k before it, which finds each vertex of
    the path once, with its distance from the end.  Returns kid, node, path (array of edges from the start, empty for the
    start itself); path is NULL when a predecessor is missing, so that the way doesn't come from the start.
    """
    jumps = [materialise(reach.where("from_node IS NOT NULL").select("kid", "node", F.col("from_node").alias("to")))]
    while True:  # distances fall along every step, so ways end and some level has no jump
        j = jumps[-1]
        far = j.join(j.select("kid", F.col("node").alias("to"), F.col("to").alias("_far")), ["kid", "to"])
        level, n = counted(far.select("kid", "node", F.col("_far").alias("to")))
        jumps.append(level)
        if n == 0:
            break
    marks = ends.select("kid", F.col("node").alias("end"), "node", F.lit(0).alias("back")).distinct()
    for k in range(len(jumps) - 2, -1, -1):
        further = marks.join(jumps[k], ["kid", "node"]).select("kid", "end", F.col("to").alias("node"), (F.col("back") + 2 ** k).alias("back"))
        marks = marks.unionByName(further)
        if k % 3 == 0:  # each level reads the one before twice: the plan is cut before it grows
            marks = materialise(marks)
    steps = marks.join(reach.select("kid", "node", "g", *EDGE), ["kid", "node"], "left")
    step = F.struct("link_id", "from_node", "is_exit", "length")
    paths = steps.groupBy("kid", "end").agg(
        F.sort_array(F.collect_list(F.when(F.col("from_node").isNotNull(), F.struct((-F.col("back")).alias("at"), step.alias("step"))))).alias("_p"),
        F.max((F.col("g") == 0) & F.col("from_node").isNull()).alias("_whole"))
    out = materialise(paths.select("kid", F.col("end").alias("node"), F.when(
        F.coalesce("_whole", F.lit(False)), F.transform("_p", lambda x: x["step"])).alias("path")))
    drop_tables(*jumps)
    return out
