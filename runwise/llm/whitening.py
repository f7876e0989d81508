"""Embedding whitening by shifted CholeskyQR.

The centred rows A are never decomposed as a whole.  Each pass over the table solves the rows against the
triangular factors found so far (Q = A / R1 / R2 ...) and adds up the Gram matrix of the result; its Cholesky
factor is the next R.  The first pass adds a shift of the size of the rounding errors, so the factor exists for any
condition number; passes repeat until Q is orthonormal.  The square root of the last Gram matrix times the
factors is R of A, and the singular values and right vectors of this small matrix are the components.

Sums and counts are exact integers; the Gram sums are of centred doubles.  A pass adds dimension x dimension numbers per
task, summed by Spark by place, so what reaches the driver (dimension x dimension) doesn't grow with the rows.

Defined results: a null vector, or one with a null or non-finite entry, gives no row, nor does one of another length than
the most frequent one (of equally frequent ones the longer) or with an entry of 2^32 or more in size, which has no exact
sums; repeated rows and null ids each count and keep their own row; vectors of one length below 8 have as many
components; a component without variance (all rows equal, fewer rows than dimensions) has explained 0 and whitened null
and doesn't count in identity_error, which is 0 when no component has any; a deviation that doesn't fit a long is null,
and ``deviation_exact`` always has it; an empty table gives an empty table; other columns aren't read by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwise.llm.common import discard, make_room, written

# Fixed values of the contract.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8

LARGEST = float(1 << 32)
PASSES = 4              # more are only taken for a rank below the dimension
NEAR_IDENTITY = 1e-6    # the root of such a Gram matrix is exact to rounding
EPS = float(np.finfo(np.float64).eps)
NO_VARIANCE = 1e-12     # of the largest variance: a smaller one is rounding


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite entries of exact size."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return rows.where(F.col(vector).isNotNull() & ~bad)


def integers(rows: DataFrame, vector: str) -> DataFrame:
    """The same rows with ``x``: the vector's entries as exact integers, little-endian 64-bit in one binary."""
    fields = [f for f in rows.schema.fields if f.name != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            column = batch.column(vector)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(flat * SCALE).astype("<i8") + OFFSET
            sizes = np.diff(column.offsets.to_numpy()) * 8
            ends = np.concatenate([[0], np.cumsum(sizes)])
            raw = x.tobytes()
            packed = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [packed], [*[f.name for f in fields], "x"])

    from pyspark.sql import types as T
    schema = T.StructType([*fields, T.StructField("x", T.BinaryType())])
    return rows.select(*[f.name for f in fields], vector).mapInArrow(run, schema)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows x dimensions of a column of packed integers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _add_up(vectors: DataFrame, dim: int, make, size: int) -> np.ndarray:
    """The sum over all tasks of the ``size`` numbers that ``make()`` gathers from a task's matrices.

    ``make()`` returns (add, total); a task emits its totals as (place, value) rows, which Spark sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        add, total = make()
        any_rows = False
        for batch in batches:
            if batch.num_rows:
                any_rows = True
                add(matrix(batch.column("x"), dim))
        if any_rows:
            values = total()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(values)], ["place", "value"])

    kind = "bigint" if make.exact else "double"
    sums = vectors.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size, np.int64 if make.exact else np.float64)
    for place, value in sums.collect():  # dim x dim numbers at most
        out[place] = value
    return out


def totals(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums of the dimensions."""
    def make():
        acc = np.zeros(dim + 1, np.int64)

        def add(x):
            acc[0] += len(x)
            acc[1:] += x.sum(axis=0)

        return add, lambda: acc

    make.exact = True
    out = _add_up(vectors, dim, make, dim + 1)
    return int(out[0]), out[1:]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n without the cancellation of large numbers: the integer part is taken off exactly."""
    base = sums // n
    return (x - base).astype(np.float64) - (sums - base * n) / n


def solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q of Q R = rows for an upper triangular R, column by column."""
    q = np.empty_like(rows)
    for j in range(r.shape[0]):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(vectors: DataFrame, dim: int, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows solved against the factors; one pass."""
    def make():
        acc = np.zeros((dim, dim))

        def add(x):
            q = centred(x, n, sums)
            for r in factors:
                q = solve(q, r)
            acc[...] += q.T @ q

        return add, lambda: acc.ravel()

    make.exact = False
    g = _add_up(vectors, dim, make, dim * dim).reshape(dim, dim)
    return (g + g.T) / 2


def shifted_cholesky(g: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular factor of g plus a shift of the size of its rounding errors; more if that isn't enough."""
    dim = g.shape[0]
    norm = float(np.trace(g)) or 1.0
    shift = 11 * (n * dim + dim * (dim + 1)) * EPS / max(n, dim) * norm
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 10


def components(vectors: DataFrame, dim: int) -> dict:
    """n, sums, and the components: unit vectors (columns), eigenvalues of the covariance and its trace."""
    n, sums = totals(vectors, dim)
    g = gram(vectors, dim, n, sums, [])
    trace = float(np.trace(g)) / n
    factors = [shifted_cholesky(g, n)]
    for _ in range(PASSES):
        g = gram(vectors, dim, n, sums, factors)
        if np.abs(g - np.eye(dim)).max() <= NEAR_IDENTITY:
            break
        try:
            factors.append(np.linalg.cholesky(g).T)
        except np.linalg.LinAlgError:  # rank below dim
            factors.append(shifted_cholesky(g, n))
    else:
        g = gram(vectors, dim, n, sums, factors)
    # What is left to orthonormal is a symmetric root of the last Gram matrix, however far it came.
    weights, vecs = np.linalg.eigh(g)
    r = np.sqrt(np.clip(weights, 0, None))[:, None] * vecs.T
    for factor in reversed(factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    top = min(COMPONENTS, dim)
    value = singular[:top] ** 2 / n
    value = np.where(value > NO_VARIANCE * max(float(singular[0]) ** 2 / n, 0.0), value, 0.0)
    vectors_ = right[:top].T
    sign = np.sign(vectors_[np.abs(vectors_).argmax(axis=0), np.arange(top)])
    return {"n": n, "sums": sums, "vectors": vectors_ * np.where(sign == 0, 1, sign), "values": value, "trace": trace}


def project(x: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows; NaN for components without variance."""
    scale = np.where(model["values"] > 0, np.sqrt(np.where(model["values"] > 0, model["values"], 1)), np.nan)
    return centred(x, model["n"], model["sums"]) @ model["vectors"] / scale


def identity_error(vectors: DataFrame, dim: int, model: dict) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity: means first, then centred products."""
    live = np.flatnonzero(model["values"] > 0)
    k, n = len(live), model["n"]
    if not k:
        return 0.0

    def means():
        acc = np.zeros(k)

        def add(x):
            acc[...] += project(x, model)[:, live].sum(axis=0)

        return add, lambda: acc

    means.exact = False
    mean = _add_up(vectors, dim, means, k) / n

    def products():
        acc = np.zeros((k, k))

        def add(x):
            w = project(x, model)[:, live] - mean
            acc[...] += w.T @ w

        return add, lambda: acc.ravel()

    products.exact = False
    covariance = _add_up(vectors, dim, products, k * k).reshape(k, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    small = int(np.abs(sums // n).max(initial=0)) + int(np.abs(x).max(initial=0)) + 1
    if small * n < 1 << 62:
        d = n * x - sums
        if int(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return (d * d).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in x.tolist()]


OUT = ("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact string")


def whiten(vectors: DataFrame, model: dict, error: float, key: str) -> DataFrame:
    """One row per vector and component (``OUT``)."""
    dim, top = model["vectors"].shape
    explained = model["values"] / model["trace"] if model["trace"] > 0 else np.zeros(top)
    n, sums = model["n"], model["sums"]
    key_type = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = matrix(batch.column("x"), dim)
            w = project(x, model).ravel()
            exact = deviations(x, n, sums)
            times = np.repeat(np.arange(rows), top)
            fits = pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(times)), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * top, n, np.int64)), fits.take(pa.array(times)), pa.array(w, mask=np.isnan(w)),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * top, error)),
                 pa.array([str(d) for d in exact]).take(pa.array(times))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    out = vectors.select(key, "x").mapInArrow(run, f"`{key}` {key_type}, {OUT}")
    return out.withColumn("deviation_exact", F.col("deviation_exact").cast("decimal(38,0)"))


def report(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The contract's columns and ``deviation_exact``."""
    rows = usable(rows.select(key, vector), vector)
    # The vectors are read by several passes: they are written once, as packed integers.
    vectors = written(integers(rows, vector).withColumn("dim", (F.length("x") / 8).cast("int")), "vectors")
    sizes = vectors.groupBy("dim").count().where("dim > 0").orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        spark = rows.sparkSession
        return spark.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, "
                                         + OUT.replace("deviation_exact string", "deviation_exact decimal(38,0)"))
    dim = sizes[0]["dim"]
    fit = vectors.where(F.col("dim") == dim)
    model = components(fit, dim)
    out = written(whiten(fit, model, identity_error(fit, dim, model), key), "whitened")
    discard(vectors)
    return out
