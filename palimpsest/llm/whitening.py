"""Whitening of embeddings on a compensated covariance.

Vectors become vectors x of whole numbers, each distinct x counts once in the fit,
and the covariance is summed in double-double: a vector is centred on the exact mean
(a pair of doubles), products and sums keep their rounding errors by error-free
transformations, and each task's sums travel as a high and a low part, which are
merged row by row of the matrix.  The eigenvectors come from LAPACK's ``syevd``:
tridiagonal reduction and divide and conquer.

An x is packed into as few bytes an entry as it needs, so the fit list is smaller
than the table.  The driver holds a matrix of the vectors' length, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as X

_WIDTHS = (1, 2, 4, 8)
_LIMIT = 2.0**62
#: Vectors whose products are summed at once; it bounds a task's memory.
_BLOCK = 512


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its error, which add up to a + b exactly."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves of 26 bits whose products are exact."""
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, a_parts: tuple, b_parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The rounded product and its error; the parts are those of :func:`split`."""
    p = a * b
    (ah, al), (bh, bl) = a_parts, b_parts
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The double-double sum over the first axis, by halves."""
    while len(high) > 1:
        if len(high) % 2:
            high, low = np.concatenate((high, np.zeros_like(high[:1]))), np.concatenate((low, np.zeros_like(low[:1])))
        high, low = add((high[::2], low[::2]), (high[1::2], low[1::2]))
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(high.shape[1:]))


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products with themselves, rows being double-doubles."""
    d = high.shape[1]
    out = np.zeros((d, d)), np.zeros((d, d))
    for k in range(0, len(high), _BLOCK):
        h, lo = high[k : k + _BLOCK], low[k : k + _BLOCK]
        parts = split(h)
        for i in range(d):  # the upper triangle, a row at a time
            one = slice(i, i + 1)
            p, e = two_product(h[:, one], h[:, i:], (parts[0][:, one], parts[1][:, one]), (parts[0][:, i:], parts[1][:, i:]))
            s, t = total(p, e + (h[:, one] * lo[:, i:] + lo[:, one] * h[:, i:]))
            out[0][i, i:], out[1][i, i:] = add((out[0][i, i:], out[1][i, i:]), (s, t))
    return out


def two_doubles(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def _pack(x: np.ndarray, origin: int) -> list[bytes]:
    """Each row of int64 as its distances from the origin, in the least width that holds them; equal rows pack alike."""
    near = np.abs(x.astype(float) - origin).max(axis=1)
    width = np.select([near < 2.0**7 - 1, near < 2.0**15 - 1, near < 2.0**31 - 1], [1, 2, 4], 8)
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width):
        at = np.nonzero(width == w)[0]
        small = (x[at] - (origin if w < 8 else 0)).astype(f"<i{w}")
        for k, row in zip(at, small, strict=True):
            out[k] = bytes([w]) + row.tobytes()
    return out


def _unpack(packed: list[bytes], d: int, origin: int) -> np.ndarray:
    x = np.empty((len(packed), d), np.int64)
    width = np.array([p[0] for p in packed])
    for w in np.unique(width):
        at = np.nonzero(width == w)[0]
        x[at] = np.frombuffer(b"".join(packed[k][1:] for k in at), f"<i{w}").reshape(-1, d).astype(np.int64) + (origin if w < 8 else 0)
    return x


@dataclass
class Model:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]
    axes: np.ndarray = None  # unit eigenvectors over the roots of their eigenvalues, one a column
    explained: np.ndarray = None
    centre: tuple[np.ndarray, np.ndarray] = None  # the mean of what the axes make of the fit list
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e = two_sum(x.astype(float), -self.mean[0])
        beyond = x - x.astype(float).astype(np.int64)  # what a double does not hold of a long
        return two_sum(s, e - self.mean[1] + beyond)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return high @ self.axes + low @ self.axes

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n * x - sum) squared."""
        s = np.array(self.sums, object)
        if self.n * float(np.abs(x).max(initial=0)) + float(max(map(abs, self.sums))) < _LIMIT:
            far = self.n * x - s.astype(np.int64)
            if float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < _LIMIT:
                return (far * far).sum(axis=1).tolist()
        far = self.n * x.astype(object) - s
        return (far * far).sum(axis=1).tolist()


def _groups(b: pa.RecordBatch, origin: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes, packed = b.column("d").to_numpy(zero_copy_only=False), b.column("x").to_pylist()
    for d in np.unique(sizes):
        yield int(d), _unpack([packed[k] for k in np.nonzero(sizes == d)[0]], int(d), origin)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """High and low parts of one row of one matrix from all tasks to their sum."""
    sums: dict[tuple[int, int], tuple] = {}
    for b in batches:
        for d, i, high, low in zip(*(b.column(c).to_pylist() for c in ("d", "i", "high", "low")), strict=True):
            part = np.frombuffer(high), np.frombuffer(low)
            sums[d, i] = add(sums[d, i], part) if (d, i) in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), *(pa.array([v[h].tobytes() for v in sums.values()], pa.binary()) for h in (0, 1))], names=["d", "i", "high", "low"])


def _matrices(fit: DataFrame, rows: Callable[[int, np.ndarray], tuple], origin: int, products: bool) -> dict[int, tuple]:
    """For each length the sum over the fit list of ``rows(d, x)`` or of its outer products, as a double-double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for b in batches:
            for d, x in _groups(b, origin):
                high, low = rows(d, x)
                part = outer_sums(high, low) if products else tuple(v[None, :] for v in total(high, low))
                held[d] = add(held[d], part) if d in held else part
        for d, (high, low) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(high), pa.int32()), pa.array(range(len(high)), pa.int32()), pa.array([r.tobytes() for r in high], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())], names=["d", "i", "high", "low"])

    layout = "d int, i int, high binary, low binary"
    merged = fit.mapInArrow(run, layout).repartition(X.partitions(fit.sparkSession), "d", "i").mapInArrow(_merge, layout)
    found: dict[int, list] = {}
    for r in merged.collect():  # as many rows as the vectors are long
        found.setdefault(r.d, []).append((r.i, np.frombuffer(r.high), np.frombuffer(r.low)))
    return {d: tuple(np.stack([r[k] for r in sorted(got, key=lambda r: r[0])]) for k in (1, 2)) for d, got in found.items()}


def eigen(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest eigenvalues that are not zero to double precision, their shares of the trace and unit vectors.

    A vector's entry of largest magnitude is positive.
    """
    e, v = np.linalg.eigh(covariance, UPLO="U")  # syevd: tridiagonal divide and conquer
    trace = covariance.trace()
    keep = [j for j in np.argsort(-e, kind="stable")[:k] if e[j] > len(e) * np.finfo(float).eps * trace]
    v = v[:, keep] * np.where(v[np.abs(v[:, keep]).argmax(axis=0), keep] < 0, -1.0, 1.0)
    return e[keep], e[keep] / trace if trace else e[keep], v


def fit_models(fit: DataFrame, k: int, origin: int) -> dict[int, Model]:
    """A model for each length of vectors; ``fit`` holds distinct packed vectors (d, x)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, x in _groups(b, origin):
                now = held.setdefault(d, [0, [0] * d])
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                now[0] += len(x)
                now[1] = [s + (h << 32) + lo for s, h, lo in zip(now[1], high, low, strict=True)]
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.decimal128(38))], names=["d", "i", "n", "s"])

    sums = fit.mapInArrow(count, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    models: dict[int, Model] = {}
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():  # as many rows as the vectors are long
        by.setdefault(r.d, {})[r.i] = (r.n, int(r.s))
    for d, got in by.items():
        n, s = got[0][0], [got[i][1] for i in range(d)]
        pairs = [two_doubles(Fraction(v, n)) for v in s]
        models[d] = Model(n, s, (np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))

    for d, (high, low) in _matrices(fit, lambda d, x: models[d].centred(x), origin, True).items():
        e, share, axes = eigen((high + low) / models[d].n, k)
        models[d].axes, models[d].explained = axes / np.sqrt(e), share

    def projected(d: int, x: np.ndarray) -> tuple:
        w = models[d].whitened(x)
        return w, np.zeros_like(w)

    for d, (high, low) in _matrices(fit, projected, origin, False).items():
        models[d].centre = high[0] / models[d].n, low[0] / models[d].n

    def recentred(d: int, x: np.ndarray) -> tuple:
        s, e = two_sum(models[d].whitened(x), -models[d].centre[0])
        return s, e - models[d].centre[1]

    for d, (high, low) in _matrices(fit, recentred, origin, True).items():
        c = np.triu(high + low) / models[d].n
        models[d].identity_error = float(np.abs(c - np.eye(len(c))).max(initial=0.0))
    return models


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: float = 64.0, origin: int = 1_000_000) -> DataFrame:
    """Each vector's whitened components: (id, component, n, deviation, whitened, explained, identity_error).

    An entry c becomes x = floor(scale * c) + origin.  The fit list holds each
    distinct x vector once: ``n`` vectors with sums S.  ``deviation`` is the exact
    sum of (n * x - S)^2, a decimal; ``whitened`` projects x - S / n on a unit
    eigenvector of the fit list's covariance, over its eigenvalue's root;
    ``explained`` is the eigenvalue's share of the trace; ``identity_error`` is the
    largest absolute entry of the whitened fit list's covariance less the identity.
    The id keeps its type and may be null; repeated rows give repeated results.

    Left out are rows whose vector is null, empty, or holds entries that are null, not
    finite, or whose x is no long.  Vectors of different lengths are fitted apart
    (each length costs the driver a matrix of that size).  A component whose
    eigenvalue is zero to double precision has no whitened values and gives no rows: a
    single vector, or a table of equal ones, gives none.  An empty table gives none.
    Columns of the table other than the two are not read.
    """
    spark = rows.sparkSession
    X.prepare(spark)

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("v")
            flat, at = lists.flatten(), np.asarray(lists.offsets)
            values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")) if len(flat) else [], float)
            size = np.where(np.asarray(lists.is_null()), 0, np.diff(at))
            for d in np.unique(size[size > 0]):
                which = np.nonzero(size == d)[0]
                with np.errstate(over="ignore", invalid="ignore"):
                    c = np.floor(scale * values[(at[which] - at[0])[:, None] + np.arange(d)])
                    fits = (np.isfinite(c) & (np.abs(c) < 2.0**63 - abs(origin) - 1024)).all(axis=1)
                if fits.any():
                    x = c[fits].astype(np.int64) + origin
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(which[fits])), pa.array(np.full(len(x), d), pa.int32()), pa.array(_pack(x, origin), pa.binary())], names=["id", "d", "x"])

    kind = rows.schema[id_col].dataType.simpleString()
    packed = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(quantised, f"id {kind}, d int, x binary")
    fit = X.checkpoint(packed.select("d", "x").distinct())
    models = fit_models(fit, components, origin)
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("d").to_numpy(zero_copy_only=False)
            for d, x in _groups(b, origin):
                m, ids = models[d], b.column("id").take(pa.array(np.nonzero(sizes == d)[0]))
                w = m.whitened(x)
                k = w.shape[1]
                each = pa.array(np.repeat(np.arange(len(x)), k))
                if k:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(k * len(x), m.n), pa.int64()), pa.array(m.deviations(x), pa.decimal128(38)).take(each), pa.array(w.ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(k * len(x), m.identity_error))],
                        names=names,
                    )

    out = packed.mapInArrow(project, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
