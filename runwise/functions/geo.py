"""Geodesy and planar geometry as native Column expressions.

The ellipsoidal distance is an iterative solver; written as one Catalyst
expression it becomes a tree too large to plan quickly, so it runs as an
Arrow-batched vectorised UDF (numpy over whole batches, arrays flattened, no
per-row Python).  Everything else here is a native Column expression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runwise.constants import GEO_EPSILON, GEO_MAX_ROUNDS, NO_ANGLE, WGS84_A, WGS84_B, WGS84_F



def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding).

    Spark has no common-subexpression elimination inside lambda functions; a
    one-element ``transform`` binds an intermediate so it is computed once.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _lit(x: float) -> Column:
    return F.lit(float(x))


def ieee_div(a: Column, b: Column) -> Column:
    """Floating division with IEEE results for a zero divisor (ANSI mode would raise)."""
    return F.when(b != 0, a / b).when(a > 0, _lit(float("inf"))).when(a < 0, _lit(float("-inf"))) \
        .otherwise(_lit(float("nan")))


PAIRS_AT_ONCE = 1 << 15  # any number gives the same distances; the solver holds some 30 arrays of as many doubles


def geodesic_np(lat1, long1, lat2, long2) -> np.ndarray:
    """``geodesic_block`` over any number of pairs, in blocks: what a worker holds doesn't grow with the batch."""
    lat1, long1, lat2, long2 = (np.asarray(x, dtype="float64") for x in (lat1, long1, lat2, long2))
    out = np.empty(len(lat1))
    for lo in range(0, len(out), PAIRS_AT_ONCE):
        part = slice(lo, lo + PAIRS_AT_ONCE)
        out[part] = geodesic_block(lat1[part], long1[part], lat2[part], long2[part])
    return out


def geodesic_block(lat1, long1, lat2, long2) -> np.ndarray:
    """Vectorised inverse ellipsoid problem (WGS-84), metres, IEEE / Java float semantics.

    Per element the iteration stops when sin(sigma) is 0 or lambda moved by at
    most GEO_EPSILON; the result is 0 for coincident points or no convergence
    within GEO_MAX_ROUNDS, NaN when both points lie on the equator.
    """
    a, b, f = WGS84_A, WGS84_B, WGS84_F
    with np.errstate(all="ignore"):
        big_l = np.radians(long2 - long1)
        u1 = np.arctan((1 - f) * np.tan(np.radians(lat1)))
        u2 = np.arctan((1 - f) * np.tan(np.radians(lat2)))
        su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        n = big_l.shape[0]
        lam = big_l.copy()
        prev = np.zeros(n)
        sin_s = np.zeros(n)
        cos_s = np.zeros(n)
        sig = np.zeros(n)
        csa = np.zeros(n)
        c2m = np.zeros(n)
        active = np.ones(n, dtype=bool)
        for _ in range(GEO_MAX_ROUNDS):
            idx = np.nonzero(active)[0]
            if idx.size == 0:
                break
            lm = lam[idx]
            sl, cl = np.sin(lm), np.cos(lm)
            t1 = cu2[idx] * sl
            t2 = cu1[idx] * su2[idx] - su1[idx] * cu2[idx] * cl
            ss = np.sqrt(t1 * t1 + t2 * t2)
            sin_s[idx] = ss
            zero = ss == 0
            go = ~zero
            active[idx[zero]] = False
            idx, lm, sl, cl, ss = idx[go], lm[go], sl[go], cl[go], ss[go]
            cs = su1[idx] * su2[idx] + cu1[idx] * cu2[idx] * cl
            sg = np.arctan2(ss, cs)
            sa = cu1[idx] * cu2[idx] * sl / ss
            ca = 1 - sa * sa
            cm = cs - 2 * su1[idx] * su2[idx] / ca
            c = f / 16 * ca * (4 + f * (4 - 3 * ca))
            new = big_l[idx] + (1 - c) * f * sa * (sg + c * ss * (cm + c * cs * (-1 + 2 * cm * cm)))
            cos_s[idx], sig[idx], csa[idx], c2m[idx] = cs, sg, ca, cm
            prev[idx] = lm
            lam[idx] = new
            active[idx[np.abs(new - lm) <= GEO_EPSILON]] = False
        u_sq = csa * (a * a - b * b) / (b * b)
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        delta = big_b * sin_s * (c2m + big_b / 4 * (cos_s * (-1 + 2 * c2m * c2m)
                                                     - big_b / 6 * c2m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * c2m * c2m)))
        dist = b * big_a * (sig - delta)
        failed = (sin_s == 0) | (np.abs(lam - prev) > GEO_EPSILON)
        return np.where(failed, 0.0, dist)


def _np(arr: pa.Array) -> np.ndarray:
    return arr.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


@F.arrow_udf(T.DoubleType())
def _vincenty_arrow(lat1: pa.Array, long1: pa.Array, lat2: pa.Array, long2: pa.Array) -> pa.Array:
    d = geodesic_np(_np(lat1), _np(long1), _np(lat2), _np(long2))
    mask = np.asarray(pc.or_(pc.or_(lat1.is_null(), long1.is_null()), pc.or_(lat2.is_null(), long2.is_null())))
    return pa.array(d, type=pa.float64(), mask=mask)


def vincenty(lat1, long1, lat2, long2) -> Column:
    """Ellipsoidal (WGS-84) inverse distance in metres for columns (Arrow-batched, vectorised)."""
    return _vincenty_arrow(lat1, long1, lat2, long2)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _pair_distances_arrow(lats: pa.Array, longs: pa.Array) -> pa.Array:
    lens = np.asarray(lats.value_lengths().fill_null(0))
    flat_lat = _np(lats.flatten())
    flat_long = _np(longs.flatten())
    total = flat_lat.shape[0]
    if total > 1:
        d = geodesic_np(flat_lat[:-1], flat_long[:-1], flat_lat[1:], flat_long[1:])
    else:
        d = np.zeros(0)
    out_lens = np.maximum(lens - 1, 0)
    # flat pair k = (k, k + 1) is valid unless k is the last element of its row
    valid = np.ones(max(total - 1, 0), dtype=bool)
    ends = np.cumsum(lens)[lens > 0] - 1
    valid[ends[ends < total - 1]] = False
    values = pa.array(d[valid] if total > 1 else np.zeros(0), type=pa.float64())
    offsets = pa.array(np.concatenate([[0], np.cumsum(out_lens)]).astype("int32"), type=pa.int32())
    out = pa.ListArray.from_arrays(offsets, values, mask=lats.is_null())
    return out


def pair_distances(positions: Column) -> Column:
    """Metres between consecutive positions of an array<struct<lat,long,...>> (n-1 values)."""
    return _pair_distances_arrow(F.transform(positions, lambda p: p["lat"]),
                                 F.transform(positions, lambda p: p["long"]))


def flat_angle(long1, lat1, long2, lat2) -> Column:
    """Degrees of atan(|dlat| / |dlong|) on absolute coordinates; NO_ANGLE if both are 0."""
    dlong = F.abs(F.abs(long1) - F.abs(long2))
    dlat = F.abs(lat1 - lat2)
    ang = F.when(dlong == 0, _lit(90.0)).otherwise(F.degrees(F.atan(dlat / dlong)))
    return F.when((dlong > 0) | (dlat > 0), ang).otherwise(_lit(NO_ANGLE))


def planar(lat1, long1, lat2, long2) -> Column:
    """Euclidean distance in degrees (used as a relative link-to-position measure)."""
    dlat, dlong = lat1 - lat2, long1 - long2
    return F.sqrt(dlat * dlat + dlong * dlong)


def pair_speeds(positions: Column, distances: Column) -> Column:
    """Speed (m/s) of each consecutive position pair; NULL when the two times are equal."""
    return F.transform(distances, lambda d, i: F.try_divide(
        d, F.abs(F.get(positions, i)["epoch_ms"].cast("double")
                 - F.get(positions, i + 1)["epoch_ms"].cast("double")) / 1000))
