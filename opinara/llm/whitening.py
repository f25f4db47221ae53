"""Embedding whitening by cyclic Jacobi rotations.

The fit list holds each distinct vector once.  Spark sums it and then its scatter about the
rounded means, both in integers, so the covariance is exact before one division, in whatever
order tasks run and however often they are repeated.  The driver gets one number for each
pair of dimensions and turns the symmetric matrix by Jacobi rotations until what is off the
diagonal vanishes relative to it, which keeps small eigenvalues accurate; rows are whitened
with the broadcast matrix (dimensions times components) in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.vectors import EXACT, LONG, common_length, matrix, scaled, whole
from opinara.session import drop_stored, stored

#: floor(SCALE * component) + OFFSET is the integer that stands for a component.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Rows that are multiplied at once.
SLICE = 1 << 12
SWEEPS = 60
NUMBER = pa.decimal128(38, 0)


def jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    Each sweep meets every pair of dimensions once, in rounds of disjoint pairs whose
    rotations are done together.  A pair rests once |a_ij| <= eps * sqrt(|a_ii * a_jj|)."""
    a, d = np.array(a, float), len(a)
    v, eps = np.eye(d), np.finfo(float).eps
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[::-1]) if max(i, j) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array(x, int) for x in zip(*pairs)) if pairs else (np.zeros(0, int),) * 2
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > eps * np.sqrt(np.abs(app) * np.abs(aqq))
            p, q, off, app, aqq = p[go], q[go], off[go], app[go], aqq[go]
            if not len(p):
                continue
            turned = True
            tau = (aqq - app) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = t * c
            for m in (a.T, v.T):  # rows of the transposed matrix are its columns
                mp, mq = m[p].copy(), m[q].copy()
                m[p], m[q] = c[:, None] * mp - s[:, None] * mq, s[:, None] * mp + c[:, None] * mq
            ap, aq = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = app - t * off, aqq + t * off
        if not turned:
            order = np.argsort(-np.diag(a), kind="stable")
            v = v[:, order]
            # either sign will do; the largest entry is made positive
            v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0) if d else v
            return np.diag(a)[order], v
    raise ArithmeticError(f"Jacobi rotations did not settle in {sweeps} sweeps")


@dataclass
class Whitening:
    """n, the sums and the covariance's eigenvalues of the fit list; ``turn`` has a component in each column."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    turn: np.ndarray
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)


def _cells(rows: DataFrame, work) -> DataFrame:
    """(cell, s): exact sums over all rows of the integers that ``work`` gives for each cell of a slice of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = work(batch.column(0).slice(at, SLICE))
                total = part if total is None else total + part
        if total is not None:
            numbers = pa.array([Decimal(int(x)) for x in total], NUMBER)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), numbers], ["cell", "s"])

    return rows.mapInArrow(run, "cell int, s decimal(38,0)").groupBy("cell").agg(F.sum("s").alias("s"))


def _numbers(rows: DataFrame, work, size: int) -> list[int]:
    out = [0] * size
    for r in _cells(rows, work).collect():  # one row for each pair of dimensions at most
        out[r.cell] = int(r.s)
    return out


def _totals(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers, exact."""
    wide = int(np.abs(x).max(initial=0)) * max(1, len(x)) >= LONG
    return (x.astype(object) if wide else x).sum(axis=0).astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """Upper triangle of y'y as Python integers, exact."""
    most = int(np.abs(y).max(initial=0)) ** 2 * max(1, len(y))
    if most < EXACT:
        whole_ = (y.astype(float).T @ y.astype(float)).astype(np.int64)
    elif most < LONG:
        whole_ = y.T @ y
    else:
        big = y.astype(object)
        whole_ = big.T @ big
    return whole_[np.triu_indices(y.shape[1])].astype(object)


def integers(rows: DataFrame, vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows with a whole vector, with ``x`` array<bigint> beside their own columns (another ``x`` goes)."""
    return rows.where(whole(vec_col)).withColumn("x", scaled(vec_col, scale, offset))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct rows of ``x`` array<bigint>; vectors of another length than the most frequent are left out.

    Components whose eigenvalue is zero, up to rounding, do not exist: nothing varies along them."""
    found = stored(vectors.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    d = common_length(found)
    listed = found.where(F.size("x") == d)
    n = listed.count() if d else 0
    if not n:
        drop_stored(found)
        return Whitening(0, [0] * d, np.zeros(0), 0.0, np.zeros((d, 0)))
    sums = _numbers(listed, lambda c: _totals(matrix(c, d)), d)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def scatter(column: pa.Array) -> np.ndarray:
        return _products(matrix(column, d) - centre)

    upper, rest = _numbers(listed, scatter, d * (d + 1) // 2), [s - n * int(c) for s, c in zip(sums, centre)]
    cov = np.zeros((d, d))
    for (i, j), s in zip(zip(*np.triu_indices(d)), upper):
        cov[i, j] = cov[j, i] = float(Fraction(n * s - rest[i] * rest[j], n * n))
    values, turn = jacobi(cov)
    real = values > d * np.finfo(float).eps * max(float(values[0]), 0.0)
    k = min(components, int(real.sum()))
    got = Whitening(n, sums, values[:k], float(np.trace(cov)), turn[:, :k] / np.sqrt(values[:k]))
    got.identity_error = _identity_error(listed, got)
    drop_stored(found)
    return got


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact."""
    sums = np.array(model.sums, np.int64)
    if int(np.abs(x).max(initial=0)) * model.n + int(np.abs(sums).max(initial=0)) >= LONG:
        raise OverflowError("n * x exceeds 64 bits; use a smaller scale")
    return x * model.n - sums


def _project(centred: np.ndarray, model: Whitening) -> np.ndarray:
    return (centred / model.n) @ model.turn


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k, d = model.turn.shape[1], model.dims
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                z = _project(_centred(matrix(batch.column(0).slice(at, SLICE), d), model), model)
                first, second = first + z.sum(axis=0), second + z.T @ z
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["cell", "s"])

    # the whitened list has mean zero up to rounding, so taking the means' product off cancels nothing
    got = np.zeros(k + k * k)
    for r in listed.mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        got[r.cell] = r.s
    mean, square = got[:k] / model.n, got[k:].reshape(k, k) / model.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """(id, component, deviation, whitened) of each row of ``x`` and each component of the model."""
    shared, d, k = rows.sparkSession.sparkContext.broadcast(model), model.dims, model.turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                centred = _centred(matrix(part.column(1), d), shared.value)
                most = int(np.abs(centred).max(initial=0))
                if most * most * max(1, d) >= LONG and max((int(x) for x in (centred.astype(object) ** 2).sum(axis=1)), default=0) >= LONG:
                    raise OverflowError("a deviation exceeds 64 bits")
                z, n = _project(centred, shared.value), part.num_rows
                ids = part.column(0).take(pa.array(np.repeat(np.arange(n), k)))
                number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([ids, number, pa.array(np.repeat((centred**2).sum(axis=1), k)), pa.array(z.ravel())], ["id", "component", "deviation", "whitened"])

    kind = rows.schema[id_col].dataType.simpleString()
    fitting = rows.where(F.size("x") == d).select(F.col(f"`{id_col}`").alias("id"), "x")
    return fitting.mapInArrow(run, f"id {kind}, component int, deviation bigint, whitened double").withColumnRenamed("id", id_col)


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each row with a whole vector.

    Rows whose vector is null or has a null or non-finite entry, or another length than most
    distinct vectors have, are not returned; repeated rows and null ids are rows like any other;
    an empty table, or one whose vectors are all equal, gives no rows, as nothing varies.
    Equal eigenvalues keep the order of the matrix.  Other columns are ignored."""
    x = integers(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")), "v", scale, offset)
    model = fit(x, components)
    share = F.element_at(F.array(*[F.lit(float(e) / model.trace) for e in model.values]), F.col("component")) if len(model.values) else F.lit(None).cast("double")
    got = transform(x, model, "id").withColumn("explained", share)
    return got.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))
