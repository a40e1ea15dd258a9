"""Whitening of embeddings: distributed centred covariance, its leading eigenvectors, projection.

Entries are taken in levels of 1/64, so that equal vectors, counts and sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.session import scratch_path

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Levels from here on have no exact double; vectors that hold one are left out like those with infinite entries.
LARGEST = 2.0**53
#: Matrix cells that a task works on at once.
CELLS = 1 << 20
#: Partial matrices that are added in one group; more of them are added in two steps.
FAN_IN = 64
#: Components count if their eigenvalue is above this share of the largest.
LEAST_SHARE = 1e-11
#: Eigenvalues that are nearer than this share of the norm form a cluster, whose vectors are made orthogonal one by one.
CLUSTER = 1e-3
SEED = 11

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenvectors of a symmetric matrix ---


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the Householder vectors of the tridiagonal form of symmetric ``a``."""
    a = np.array(a, np.float64)
    d, turns = len(a), []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size:
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, a[k + 1, k])
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), turns


def turn_back(y: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal form in the coordinates of the whole matrix."""
    y = y.copy()
    for k in range(len(turns) - 1, -1, -1):
        y[k + 1 :] -= 2 * turns[k] * (turns[k] @ y[k + 1 :])
    return y


def count_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of ``at``."""
    tiny = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    below = np.zeros(len(at), np.int64)
    q, before = np.ones(len(at)), 0.0
    for a, b in zip(diag, [*off**2, 0.0], strict=True):
        q = a - at - before / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
        before = b
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection on Sturm counts."""
    reach = np.r_[np.abs(off), 0.0] + np.r_[0.0, np.abs(off)]
    low, high = np.full(k, (diag - reach).min()), np.full(k, (diag + reach).max())
    margin = np.spacing(max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)) * len(diag)
    low, high = low - margin, high + margin
    most = len(diag) - 1 - np.arange(k)
    while True:
        mid = (low + high) / 2
        if ((mid <= low) | (mid >= high)).all():
            return mid
        under = count_below(diag, off, mid) <= most
        low, high = np.where(under, mid, low), np.where(under, high, mid)


def shifted_solver(diag: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) x = b by elimination with row exchanges; pivots below ``least`` are raised to it."""
    d = len(diag)
    pivot, one, two = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * d
    steps = []
    for i in range(d - 1):
        below = float(off[i])
        if abs(pivot[i]) >= abs(below):
            pivot[i] = pivot[i] if abs(pivot[i]) >= least else least
            times = below / pivot[i]
            pivot[i + 1] -= times * one[i]
            steps.append((False, times))
        else:
            times = pivot[i] / below
            pivot[i], pivot[i + 1], one[i], two[i] = below, one[i] - times * pivot[i + 1], pivot[i + 1], one[i + 1]
            one[i + 1] *= -times
            steps.append((True, times))
    pivot[-1] = pivot[-1] if abs(pivot[-1]) >= least else least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i, (exchanged, times) in enumerate(steps):
            if exchanged:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= times * x[i]
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] - (one[i] * x[i + 1] if i + 1 < d else 0.0) - (two[i] * x[i + 2] if i + 2 < d else 0.0)) / pivot[i]
        return np.array(x)

    return solve


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Unit eigenvectors of falling ``values`` by inverse iteration, orthogonal within each cluster."""
    d, rng = len(diag), np.random.default_rng(SEED)
    if d == 1:
        return [np.ones(1)]
    norm = max(float(np.abs(diag).max() + 2 * np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    out: list[np.ndarray] = []
    first = 0  # of the cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        solve = shifted_solver(diag, off, value, eps * norm)
        x = rng.standard_normal(d)
        for _ in range(12):
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                for y in out[first:]:
                    x -= (x @ y) * y
            x /= np.linalg.norm(x)
            left = diag * x - value * x
            left[1:] += off * x[:-1]
            left[:-1] += off * x[1:]
            if np.abs(left).max() <= 8 * eps * norm:
                break
        if np.abs(left).max() > 1e-9 * norm:
            raise ArithmeticError(f"no eigenvector found at {value}")
        out.append(x)
    return out


def leading_eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of symmetric ``v``, falling, and their unit vectors as columns.

    Householder reflections make the matrix tridiagonal; in each block between negligible
    off-diagonals, bisection on Sturm counts finds the values, inverse iteration the vectors.
    """
    k = min(k, len(v))
    if not k:
        return np.zeros(0), np.zeros((len(v), 0))
    diag, off, turns = tridiagonal(v)
    norm = float(np.abs(diag).max() + 2 * np.abs(off).max(initial=0.0))
    cuts = np.flatnonzero(np.abs(off) <= np.finfo(float).eps * norm) + 1
    found = []  # equal values can only lie in different blocks, which share no coordinate
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(v)], strict=True):
        own, between = diag[a:b], off[a : b - 1]
        values = leading_values(own, between, min(k, b - a))
        for value, y in zip(values, leading_vectors(own, between, values), strict=True):
            found.append((value, np.r_[np.zeros(a), y, np.zeros(len(v) - b)]))
    found.sort(key=lambda f: -f[0])
    return np.array([f[0] for f in found[:k]]), np.stack([turn_back(y, turns) for _, y in found[:k]], axis=1)


# --- vectors in batches ---


def levels(column: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and levels (floor of 64 times each entry) of the usable vectors of length ``d``, in slices of bounded size."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right, step = np.flatnonzero(size == d), max(1, CELLS // d)
    for a in range(0, len(right), step):
        own = right[a : a + step]
        with np.errstate(over="ignore", invalid="ignore"):
            m = np.floor(SCALE * column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))
            good = (np.abs(m) < LARGEST).all(axis=1)
        yield own[good], m[good].astype(np.int64)


def pack(m: np.ndarray) -> list[bytes]:
    """Each row's levels in 2, 4 or 8 bytes an entry, as few as its own entries allow."""
    most = np.maximum(m, -1 - m).max(axis=1, initial=0)
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    out = np.empty(len(m), object)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        raw, step = m[rows].astype(f"<i{w}").tobytes(), int(w) * m.shape[1]
        out[rows] = [raw[k * step : (k + 1) * step] for k in range(len(rows))]
    return out.tolist()


def unpack(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The rows of ``pack`` again, in slices of bounded size."""
    step = max(1, CELLS // d)
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        size = pc.binary_length(part).to_numpy()
        for w in np.unique(size):
            own = part.filter(pa.array(size == w))
            yield np.frombuffer(b"".join(own.to_pylist()), f"<i{int(w) // d}").reshape(-1, d).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, m in levels(batch.column("embedding"), d):
            yield pa.RecordBatch.from_arrays([pa.array(pack(m), pa.binary())], names=["x"])


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
    for batch in batches:
        for m in unpack(batch.column("x"), d):
            n += len(m)
            high += (m >> 27).sum(axis=0)
            low += (m & ((1 << 27) - 1)).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])


def _products(batches: Iterator[pa.RecordBatch], d: int, of: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for m in unpack(batch.column("x"), d):
            y = of(m)
            total = y.T @ y if total is None else total + y.T @ y
    if total is not None:
        k, part = len(total), TaskContext.get().partitionId() // FAN_IN
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, k * k + 1, k, dtype=np.int32)), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part, np.int32)), rows], names=["i", "part", "row"])


def _add(table: pa.Table) -> pa.Table:
    rows = table.column("row").combine_chunks()
    total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table({"i": table.column("i").slice(0, 1).cast(pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})


def summed_products(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of y y' over the fit list, y being what ``of`` makes of a row; tasks add up their own rows first."""
    parts = fit.mapInArrow(lambda it: _products(it, d, of), "i int, part int, row array<double>")
    parts = parts.groupBy("i", "part").applyInArrow(_add, "i int, row array<double>")
    total = parts.groupBy("i").applyInArrow(_add, "i int, row array<double>").toArrow().sort_by("i")
    return np.array(total.column("row").to_pylist())


class Whitening:
    """A fitted whitening: ``n`` and exact sums of the fit list, components, their eigenvalues and what they explain."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        #: the means' whole parts, what is left of the sums, and both as they are subtracted
        self.whole, self.rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        self.fraction = self.rest / n
        self.axes, self.explained, self.identity_error = np.zeros((self.d, 0)), np.zeros(0), 0.0

    def centred(self, m: np.ndarray) -> np.ndarray:
        return (m - self.whole).astype(np.float64) - self.fraction

    def projected(self, m: np.ndarray) -> np.ndarray:
        return self.centred(m) @ self.axes

    def deviations(self, m: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None where a long can't hold it."""
        r = m - self.whole
        with np.errstate(over="ignore"):
            rough = ((self.n * (np.abs(r) + 1.0)) ** 2).sum(axis=1)
            out = ((self.n * r - self.rest) ** 2).sum(axis=1).tolist()
        for k in np.flatnonzero(rough >= 2.0**62):
            exact = sum((self.n * a - b) ** 2 for a, b in zip(r[k].tolist(), self.rest.tolist(), strict=True))
            out[k] = exact if exact < 1 << 63 else None
        return out


def fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """``x``: each distinct usable vector's packed levels, once; written to the shared folder and read again."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening-fit")
    vectors.select("embedding").mapInArrow(lambda it: _packed(it, d), "x binary").distinct().write.parquet(path)
    return spark.read.schema("x binary").parquet(path)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct usable vectors of ``vectors`` (column embedding); None if there is none.

    Usable are vectors of the commonest length (of several, the longest) whose entries are
    all finite and below 2^53 levels. Three passes over the fit list: sums, centred products,
    and the check of the whitened rows. Only matrices of that length come to the driver.
    """
    top = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d = top.d
    rows = fit_list(vectors, d)
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = rows.mapInArrow(lambda it: _sums(it, d), "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("i").collect()
    if not sums:
        return None
    w = Whitening(sums[0].n, [(int(r.high) << 27) + int(r.low) for r in sums])
    v = summed_products(rows, d, w.centred) / w.n
    values, axes = leading_eigenpairs(v, components)
    keep = values > LEAST_SHARE * max(values[0], 0.0)
    values, axes = values[keep], axes[:, keep]
    w.axes, w.explained = axes / np.sqrt(values), values / np.trace(v)
    if len(values):
        # with a column of ones the products hold the sums as well
        s = summed_products(rows, d, lambda m: np.hstack([w.projected(m), np.ones((len(m), 1))])) / w.n
        w.identity_error = float(np.abs(s[:-1, :-1] - np.outer(s[-1, :-1], s[-1, :-1]) - np.eye(len(values))).max())
    return w


def _rows(batches: Iterator[pa.RecordBatch], w: Whitening) -> Iterator[pa.RecordBatch]:
    k = w.axes.shape[1]
    for batch in batches:
        for at, m in levels(batch.column("embedding"), w.d):
            place = np.repeat(np.arange(len(m)), k)
            ids, deviation = batch.column("vec_id").take(pa.array(at)), pa.array(w.deviations(m), pa.int64())
            tiled = lambda x, n=len(m): pa.array(np.tile(x, n))
            same = lambda x, n=len(m) * k: pa.array(np.full(n, x))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(place)), tiled(np.arange(1, k + 1, dtype=np.int32)), same(np.int64(w.n)), deviation.take(pa.array(place)), pa.array(w.projected(m).ravel()), tiled(w.explained), same(w.identity_error)],
                names=[c.split()[0] for c in OUTPUT.split(", ")],
            )


def usable_input(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, with types as the batches take them."""
    kind = dict(vectors.dtypes)["embedding"]
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row, repeated rows included.

    ``vectors`` has vec_id and embedding; other columns are ignored. Null vectors, those that
    hold null, infinite or undefined entries, and those of another length than most are left
    out; a null vec_id is kept. There are as many components as eigenvalues above rounding,
    so that vectors that are all equal give no rows, like an empty table. The projection is
    broadcast: a matrix of the vectors' length times ``components``.
    """
    spark: SparkSession = vectors.sparkSession
    vectors = usable_input(vectors)
    w = fit(vectors, components)
    if w is None or not w.axes.shape[1]:
        return spark.createDataFrame([], OUTPUT)
    held = spark.sparkContext.broadcast(w)
    return vectors.mapInArrow(lambda it: _rows(it, held.value), OUTPUT)
