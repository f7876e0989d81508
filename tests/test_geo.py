import math

import numpy as np
from pyspark.sql import functions as F

from runwise.functions.geo import geodesic_np, pair_distances, vincenty


def test_known_distances_numpy():
    d = geodesic_np([33.43, 33.43, 0.0, 0.0, 50.0663889], [-112.03, -112.03, 0.0, 0.0, -5.7147222],
                    [33.44, 33.43, 0.0, 0.5, 58.6438889], [-112.02, -112.03, 1.0, 179.7, -3.07])
    assert d[0] == 1447.377650722827
    assert d[1] == 0.0                       # coincident
    assert math.isnan(d[2])                  # both on the equator
    assert d[3] == 0.0                       # near-antipodal: no convergence
    assert abs(d[4] - 969932.987) < 1e-3


def test_vincenty_column_and_pairs(spark):
    df = spark.createDataFrame([(33.43, -112.03, 33.44, -112.02), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    out = [r[0] for r in df.select(vincenty("a", "b", "c", "d")).collect()]
    assert out[0] == 1447.377650722827 and out[1] is None
    p = spark.createDataFrame([([(33.43, -112.03, 0), (33.44, -112.02, 1000), (33.44, -112.02, 2000)],), ([],), (None,)],
                              "p array<struct<lat:double,long:double,epoch_ms:bigint>>")
    rows = [r[0] for r in p.select(pair_distances(F.col("p"))).collect()]
    assert rows[0] == [1447.377650722827, 0.0] and rows[1] == [] and rows[2] is None


def test_blocks_hold_little_and_change_nothing():
    import tracemalloc

    from runwise.functions import geo
    lat, long = 33.0 + np.arange(1_000_001) % 977 * 1e-4, -112.0 + np.arange(1_000_001) % 1013 * 1e-4
    tracemalloc.start()
    d = geodesic_np(lat[:-1], long[:-1], lat[1:], long[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    some = slice(geo.PAIRS_AT_ONCE - 50, geo.PAIRS_AT_ONCE + 50)
    assert (d[some] == geodesic_np(lat[:-1][some], long[:-1][some], lat[1:][some], long[1:][some])).all()
    assert len(geodesic_np([], [], [], [])) == 0


def test_numpy_matches_iteration_limit():
    # vectorised rows converge independently
    lat = np.full(1000, 33.43)
    d = geodesic_np(lat, np.linspace(-112.03, -112.0, 1000), lat, np.full(1000, -112.01))
    assert np.all(np.isfinite(d)) and d.min() >= 0
