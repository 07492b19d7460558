"""Embedding whitening: streamed moments, merged in a tree, and a symmetric QR eigen-solve.

Vectors are put on a grid of whole numbers, and each distinct one counts once. Every
partition streams its vectors through Welford's rank-one updates of mean and scatter;
the states of partitions are merged by the parallel update formula, a few dozen at a
time. The covariance goes through Householder reflections to a tridiagonal matrix, and by
implicit QR steps with Wilkinson shifts to its eigenvalues and eigenvectors. The rows are
projected on the first components; a second stream of moments, over the projected
vectors, measures how far their covariance is from the identity.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, over_arrow

COMPONENTS = 16
#: Steps of the grid in a unit, and where its 0 is.
STEPS, ZERO = 64, 1_000_000
#: Entries beyond this, in steps of the grid, count as this.
FAR = 1 << 52
#: States that one task, or the driver, merges.
FAN_IN = 32


# --- moments ----------------------------------------------------------------------


@dataclass
class Moments:
    """Number, mean and scatter about the mean of vectors, and their exact sum."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    total: list[int]

    @classmethod
    def of(cls, dims: int) -> Moments:
        return cls(0, np.zeros(dims), np.zeros((dims, dims)), [0] * dims)

    def add(self, x: np.ndarray) -> None:
        """A rank-one update for each row of x."""
        if x.dtype == np.int64:
            self.total = [a + b for a, b in zip(self.total, x.sum(0).tolist(), strict=True)]
        for row in x.astype(np.float64):
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            self.scatter += np.outer(before, row - self.mean)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, [a + b for a, b in zip(self.total, other.total, strict=True)])

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


STATE = "dims int, at int, n long, mean binary, scatter binary, total array<string>"
_STATE = pa.schema([("dims", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("scatter", pa.binary()), ("total", pa.list_(pa.string()))])


def _packed(states: dict[int, Moments], at: int) -> pa.RecordBatch:
    rows = [{"dims": d, "at": at, "n": m.n, "mean": m.mean.tobytes(), "scatter": m.scatter.tobytes(), "total": list(map(str, m.total))} for d, m in states.items()]
    return pa.RecordBatch.from_pylist(rows, _STATE)


def _unpacked(t: pa.Table | pa.RecordBatch) -> Iterator[Moments]:
    for r in t.to_pylist():
        d = r["dims"]
        yield Moments(r["n"], np.frombuffer(r["mean"], np.float64), np.frombuffer(r["scatter"], np.float64).reshape(d, d), list(map(int, r["total"])))


def _merged(key: tuple, t: pa.Table) -> pa.Table:
    dims, at = key[0].as_py(), key[1].as_py()
    return pa.Table.from_batches([_packed({dims: functools.reduce(Moments.merge, _unpacked(t))}, at)])


def moments(vectors: DataFrame, seen: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[int, Moments]:
    """Moments by length of seen(x) for the vectors (x binary, of int64), whose rows are streamed; FAN_IN states a length come to the driver."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for b in batches:
            for _, x in by_length(b.column("x")):
                y = seen(x)
                states.setdefault(y.shape[1], Moments.of(y.shape[1])).add(y)
        if states:
            yield _packed(states, 0)

    parts = vectors.rdd.getNumPartitions()
    states = vectors.select("x").mapInArrow(stream, STATE).withColumn("at", F.spark_partition_id())
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        states = states.withColumn("at", F.col("at") % parts).groupBy("dims", "at").applyInArrow(_merged, STATE)
    out: dict[int, Moments] = {}
    for m in _unpacked(states.toArrow()):
        d = len(m.mean)
        out[d] = out[d].merge(m) if d in out else m
    return out


def by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length among packed vectors."""
    packed = col.to_pylist()
    size = np.array([len(p) for p in packed], np.int64)
    for s in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == s)
        yield at, np.frombuffer(b"".join(packed[i] for i in at), np.int64).reshape(len(at), s // 8)


# --- eigenvalues ------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the one beside it, Q) with v = Q T Q', by Householder reflections."""
    a, n = v.astype(np.float64).copy(), len(v)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not np.any(x[1:]):
            continue
        u = x / np.abs(x).max()  # squares of small entries must not vanish
        size = np.linalg.norm(u)
        u[0] += size if u[0] >= 0 else -size
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(u, u @ rest)
        rest = a[k:, k + 1 :]
        rest -= 2 * np.outer(rest @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    d, e, q = tridiagonal(v)
    q = np.ascontiguousarray(q.T)  # rows are turned, as they lie together
    tiny = np.finfo(np.float64).eps
    least = tiny * tiny * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))  # far below the error of rounding
    hi, steps = len(d) - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= np.maximum(tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])), least)
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        steps += 1
        if steps > 100:
            raise ArithmeticError("the eigenvalues did not settle")
        # The shift is the eigenvalue of the last two rows that is nearer to the last entry.
        half, beside = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        root = np.hypot(half, beside)
        shift = d[hi] - beside * beside / (half + (root if half >= 0 else -root))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a, b, g = d[k], d[k + 1], e[k]
            d[k] = c * c * a + 2 * c * s * g + s * s * b
            d[k + 1] = s * s * a - 2 * c * s * g + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * g
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper, lower = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
            q[k], q[k + 1] = upper, lower
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[order]
    q *= np.where(q[np.arange(len(q)), np.abs(q).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return d, q.T


# --- whitening --------------------------------------------------------------------


@dataclass
class Model:
    """What whitens the vectors of one length."""

    n: int
    total: list[int]
    values: np.ndarray  # of the components
    vectors: np.ndarray  # their unit vectors, as columns
    trace: float
    identity_error: float | None = None

    @property
    def varies(self) -> np.ndarray:
        """Components that have a variance beyond rounding."""
        return self.values > len(self.total) * np.finfo(np.float64).eps * self.values[:1]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, projected, over the root of the eigenvalues; NaN where nothing varies."""
        mean = [divmod(s, self.n) for s in self.total]
        whole = np.array([w for w, _ in mean], np.int64)
        part = np.array([r / self.n for _, r in mean])
        with np.errstate(divide="ignore", invalid="ignore"):
            out = ((x - whole) - part) @ self.vectors / np.sqrt(self.values)
        out[:, ~self.varies] = np.nan
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S) ** 2 for each row, exactly; None beyond a long."""
        room = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.total), default=0)
        if room * room * len(self.total) < 1 << 62:
            return ((self.n * x - np.array(self.total, np.int64)) ** 2).sum(1).tolist()
        low = (self.n * int(x.min()), self.n * int(x.max()))
        if max(abs(low[i] - s) for s in self.total for i in (0, 1)) ** 2 * len(self.total) < 1 << 62 and max(map(abs, low)) < 1 << 62:
            return ((self.n * x - np.array(self.total, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def on_grid(col: pa.Array) -> list[bytes | None]:
    """Each vector's entries c as int64 floor(64 c) + 1000000, packed; None for null vectors and those with null or non-finite entries."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = col.offsets.to_numpy()
    values = col.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(col) else col.values
    offsets = offsets - offsets[0]
    c = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(c))))
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.clip(np.nan_to_num(np.floor(STEPS * c)), -FAR, FAR).astype(np.int64) + ZERO
    fine = (odd[offsets[1:]] == odd[offsets[:-1]]) & pc.is_valid(col).to_numpy(zero_copy_only=False)
    return [x[s:e].tobytes() if ok else None for s, e, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), fine.tolist(), strict=True)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length among the distinct vectors (x binary)."""
    models: dict[int, Model] = {}
    for dims, m in moments(vectors).items():
        v = m.covariance()
        values, axes = symmetric_qr(v)
        models[dims] = Model(m.n, m.total, np.maximum(values[:components], 0), axes[:, :components], float(np.trace(v)))

    # The whitened vectors' own moments; those of a length are told apart by a first entry.
    def whitened(x: np.ndarray) -> np.ndarray:
        model = models[x.shape[1]]
        return model.whiten(x)[:, model.varies]

    for dims, model in models.items():
        if model.varies.any():
            mine = vectors.where(F.octet_length("x") == 8 * dims) if len(models) > 1 else vectors
            (own,) = moments(mine, whitened).values()
            model.identity_error = float(np.abs(own.covariance() - np.eye(len(own.mean))).max())
    return models


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten_embeddings(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and component.

    Null vectors, and those with a null, NaN or infinite entry, are dropped; so are empty
    ones, which have no component. The others stay, repeated rows and null ids too, and
    each distinct vector on the grid counts once in the fit. Vectors of different lengths
    are fitted apart, one model a length. Entries beyond 2**52 steps count as that. A
    deviation beyond a long is null. A component without variance has a null whitened
    value and an explained share of 0; without any such component identity_error is null.
    The driver and the executors get `components` vectors a length, and the driver solves
    one matrix of dims x dims for each. An empty table gives none. Other columns are not
    read.
    """
    spark = embeddings.sparkSession

    def pack(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(on_grid(b.column("embedding")), pa.binary())], ["vec_id", "x"])

    packed = over_arrow(embeddings.select("vec_id", "embedding"), pack, "vec_id long, x binary").where("octet_length(x) > 0")
    models = spark.sparkContext.broadcast(fit(materialize(packed.select("x").distinct(), "vectors"), components))

    def project(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = b.column("vec_id")
        for at, x in by_length(b.column("x")):
            model = models.value[x.shape[1]]
            k = len(model.values)
            shares = model.values / model.trace if model.trace else np.zeros(k)
            white = model.whiten(x)
            rows = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(white.ravel(), from_pandas=True),
                    pa.array(np.tile(shares, rows)),
                    pa.array([model.identity_error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return over_arrow(packed, project, WHITENED)
