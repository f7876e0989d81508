"""best_paths against a literal early-stopping A* run on the fixture grid (brute force, small input)."""

import random

from runwise.functions.geo import geodesic_np
from runwise.operators import paths as P
from runwise.plans import catalog


def literal_search(nodes, edges, start, goal, avoid):
    """Pop the unvisited vertex of least dist + heuristic; stop once it touches the goal."""
    coords = {n: (lat, lon) for n, lat, lon in nodes}
    adj = {}
    for lid, a, b, length in edges:
        adj.setdefault(a, []).append((b, lid, length))
        adj.setdefault(b, []).append((a, lid, length))
    if goal == avoid:
        return None
    direct = any(b == goal for b, _, _ in adj.get(start, []))
    removed = None if (direct or start == avoid) else avoid
    order = [n for n, _, _ in nodes if n != removed]
    gl = coords[goal]
    h = {n: float(geodesic_np([coords[n][0]], [coords[n][1]], [gl[0]], [gl[1]])[0]) * 3.28084 for n in order}
    dist = {n: (0.0 if n == start else float("inf")) for n in order}
    via, visited = {}, set()
    while True:
        cands = [n for n in order if n not in visited]
        cur = min(cands, key=lambda n: dist[n] + h[n])
        if dist[cur] == float("inf"):
            return None
        visited.add(cur)
        for b, lid, length in adj.get(cur, []):
            if b in dist and b != goal and dist[cur] + length < dist[b]:
                dist[b], via[b] = dist[cur] + length, (cur, lid)
        touch = [(lid, length) for b, lid, length in adj.get(cur, []) if b == goal]
        if touch:
            path, n = [touch[0][0]], cur
            while n != start:
                n, lid = via[n]
                path.append(lid)
            return list(reversed(path))


def test_best_paths_match_literal_search(spark, sf):
    nodes_df, edges_df = catalog.network(spark, sf)
    nodes = [(r.node_id, r.lat, r.long) for r in nodes_df.collect()]
    edges = [(r.link_id, r.src, r.dst, r.length) for r in edges_df.collect()]
    ids = [n for n, _, _ in nodes]
    rnd = random.Random(7)
    keys = []
    while len(keys) < 12:
        s, g, a = rnd.sample(ids, 3)
        keys.append((s, g, a))
    keys.append(("0", "110", "1"))          # avoided vertex cuts the only way out
    keys.append(("0", "110", "110"))        # the goal itself is avoided
    keys.append(("3", "4", "4"))            # avoided, but next to the start
    kdf = spark.createDataFrame(keys, "start string, goal string, avoid string")
    got = {(r.start, r.goal, r.avoid): (None if r.path is None else [s.link_id for s in r.path])
           for r in P.best_paths(kdf, nodes_df, edges_df).collect()}
    for k in keys:
        assert got[k] == literal_search(nodes, edges, *k), k


def test_heuristic_condition(spark, sf):
    nodes, edges = catalog.network(spark, sf)
    assert P.check_heuristic(nodes, edges).count() == 0
    from pyspark.sql import functions as F
    short = edges.withColumn("length", F.when(F.col("link_id") == "1003", F.lit(1.0)).otherwise(F.col("length")))
    assert [r["link_id"] for r in P.check_heuristic(nodes, short).collect()] == ["1003"]
