"""Searches against literal ones on random networks, traces, and the store of solved paths (brute force, small input)."""

import random

import pytest
from pyspark.sql import functions as F
from test_paths import literal_search

from runwise.operators import path_store, search
from runwise.operators import paths as P
from runwise.session import counted

EDGES = "link_id string, link_name string, src string, dst string, length double, is_exit int"
NODES = "node_id string, node_name string, lat double, long double"
KEYS = "start string, goal string, avoid string"


def network(spark, seed, short=0.0, n=12, extra=9):
    """A random connected network; a share ``short`` of the links is far shorter than its geodesic."""
    rnd = random.Random(seed)
    nodes = [(f"n{k:02d}", f"N{k}", 33.4 + rnd.random() / 50, -112.0 + rnd.random() / 50) for k in range(n)]
    pairs = {(k, rnd.randrange(k)) for k in range(1, n)} | {tuple(rnd.sample(range(n), 2)) for _ in range(extra)}
    pairs = {(min(p), max(p)) for p in pairs}
    edges = []
    for i, (a, b) in enumerate(sorted(pairs)):
        from runwise.functions.geo import geodesic_np
        direct = float(geodesic_np([nodes[a][2]], [nodes[a][3]], [nodes[b][2]], [nodes[b][3]])[0]) * 3.28084
        length = direct * (rnd.uniform(0.05, 0.6) if rnd.random() < short else rnd.uniform(1.01, 1.6))
        edges.append((f"e{i:03d}", "x", nodes[a][0], nodes[b][0], length, 0))
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def some_keys(nodes, edges, seed, n):
    rnd = random.Random(seed)
    ids = [x[0] for x in nodes]
    keys = {tuple(rnd.sample(ids, 3)) for _ in range(n)} | {(*rnd.sample(ids, 2), None) for _ in range(5)}
    return sorted(keys, key=str)


@pytest.mark.parametrize("seed,short", [(1, 0.0), (2, 0.5)])
def test_first_touch_equals_literal_search(spark, seed, short):
    nodes, edges, ndf, edf = network(spark, seed, short)
    assert P.check_heuristic(ndf, edf).isEmpty() == (short == 0.0)
    keys = some_keys(nodes, edges, seed, 40)
    got = {(r.start, r.goal, r.avoid): r.path and [s.link_id for s in r.path]
           for r in P.best_paths(spark.createDataFrame(keys, KEYS), ndf, edf).collect()}
    flat = [(n, lat, long) for n, _, lat, long in nodes]
    lines = [(e[0], e[2], e[3], e[4]) for e in edges]
    for k in keys:
        assert got[k] == literal_search(flat, lines, *k), k


def test_bands_pop_more_than_one_vertex_a_round(spark, monkeypatch):
    nodes, edges, ndf, edf = network(spark, 4, 0.3)
    bands = []
    monkeypatch.setattr(search, "counted", lambda df: (lambda t: bands.append((df.columns, t[1])) or t)(counted(df)))
    P.best_paths(spark.createDataFrame([("n00", "n11", None)], KEYS), ndf, edf).collect()
    popped = [n for columns, n in bands if "touch" in columns]
    assert max(popped) > 1 and len(popped) < len(nodes)


def shortest_by_hand(edges, start, goal, avoid):
    import heapq
    adj = {}
    for lid, _, a, b, length, _ in edges:
        adj.setdefault(a, []).append((b, length))
        adj.setdefault(b, []).append((a, length))
    avoid = None if start == avoid or any(b == goal for b, _ in adj.get(start, [])) else avoid
    heap, done = [(0.0, start)], {}
    while heap:
        g, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = g
        for w, length in adj.get(v, []):
            if w != avoid:
                heapq.heappush(heap, (g + length, w))
    return done.get(goal)


def test_exact_stop_is_shortest(spark):
    nodes, edges, ndf, edf = network(spark, 5, 0.5)
    keys = [k for k in some_keys(nodes, edges, 5, 30) if k[1] != k[2]]
    rows = P.best_paths(spark.createDataFrame(keys, KEYS), ndf, edf, stop="exact").collect()
    assert len(rows) == len(keys)
    for r in rows:
        want = shortest_by_hand(edges, r.start, r.goal, r.avoid)
        assert (r.path is None) == (want is None)
        if want is not None:
            assert sum(s.length for s in r.path) == pytest.approx(want, rel=1e-12)
            at = r.start
            for s in r.path:
                assert s.from_node == at
                e = next(x for x in edges if x[0] == s.link_id)
                at = e[3] if e[2] == at else e[2]
            assert at == r.goal


def test_parallel_and_zero_length_links(spark):
    nodes = [("a", "A", 33.4, -112.0), ("b", "B", 33.4, -112.001), ("c", "C", 33.4, -112.002), ("d", "D", 33.4, -112.003)]
    edges = [("e2", "x", "a", "b", 400.0, 0), ("e1", "x", "a", "b", 400.0, 0), ("e3", "x", "b", "c", 0.0, 0), ("e4", "x", "c", "d", 400.0, 0)]
    ndf, edf = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    r = P.best_paths(spark.createDataFrame([("a", "d", None)], KEYS), ndf, edf, stop="exact").first()
    assert [s.link_id for s in r.path] == ["e1", "e3", "e4"]


def test_what_a_round_writes_shrinks_with_the_frontier(spark, monkeypatch):
    """Rows written per round on a long line: the new vertices only, not all known ones."""
    n = 40
    nodes = [(f"n{k:02d}", "x", 33.4, -112.0 + 0.001 * k) for k in range(n)]
    edges = [(f"e{k:02d}", "x", f"n{k:02d}", f"n{k + 1:02d}", 400.0, 0) for k in range(n - 1)]
    und = search.with_cost(P.undirected(spark.createDataFrame(edges, EDGES)))
    keys = spark.createDataFrame([(1, "n00", "n39", None)], "kid long, start string, goal string, avoid_eff string")
    sizes = []
    monkeypatch.setattr(search, "counted", lambda df: (lambda t: sizes.append(t[1]) or t)(counted(df)))
    reach = search.shortest(keys, und, through_goal=True, steps=4)
    assert reach.count() == n
    assert sizes == [4] * 9 + [3, 0]


def test_trace_by_pointer_doubling(spark):
    """Ways of every length, a vertex without a way back, and one that nothing reached."""
    rows = [(1, f"v{k:03d}", float(k), f"v{k - 1:03d}" if k else None, f"l{k}" if k else None, 0 if k else None, 1.0 if k else None) for k in range(70)]
    rows += [(2, "x1", 1.0, "x0", "m", 0, 1.0)]
    reach = spark.createDataFrame(rows, "kid long, node string, g double, from_node string, link_id string, is_exit int, length double")
    ends = spark.createDataFrame([(1, f"v{k:03d}") for k in (0, 1, 2, 3, 7, 8, 31, 32, 33, 63, 64, 69)] + [(2, "x1"), (2, "y")], "kid long, node string")
    got = {(r.kid, r.node): r.path and [s.link_id for s in r.path] if r.path is not None else None for r in search.trace(reach, ends).collect()}
    assert got.pop((2, "x1")) is None and got.pop((2, "y")) is None
    for (_, node), path in got.items():
        assert (path or []) == [f"l{k}" for k in range(1, int(node[1:]) + 1)]


def test_store_solves_only_new_keys(spark, tmp_path, monkeypatch):
    nodes, edges, ndf, edf = network(spark, 6)
    keys = some_keys(nodes, edges, 6, 20)
    whole = P.best_paths(spark.createDataFrame(keys, KEYS), ndf, edf)
    solved = []
    real = P.best_paths
    monkeypatch.setattr(P, "best_paths", lambda k, *a, **kw: solved.append({tuple(r) for r in k.collect()}) or real(k, *a, **kw))
    folder = str(tmp_path / "store")
    first = spark.createDataFrame(keys[:12], KEYS)
    assert path_store.solve(first, ndf, edf, store=folder).count() == 12
    again = path_store.solve(spark.createDataFrame(keys + keys, KEYS), ndf, edf, store=folder)
    assert solved == [set(keys[:12]), set(keys[12:])]
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.collect()))
    path_store.solve(first, ndf, edf, store=folder)
    assert len(solved) == 2
    longer = edf.withColumn("length", F.col("length") * 1.5)   # another network or stop rule: nothing of the old one is used
    tables = {path_store.table_of(folder, ndf, e, stop) for e, stop in ((edf, "first_touch"), (longer, "first_touch"), (edf, "exact"))}
    assert len(tables) == 3
    assert path_store.network_digest(ndf, edf, "exact") == path_store.network_digest(ndf.orderBy("lat"), edf.repartition(5), "exact")
