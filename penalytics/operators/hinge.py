"""Several linear SVMs on one frame's random Fourier features, fitted by passes that they share.

``LinearSVC`` keeps the features of each fit's rows and reads them for every point that its line search
tries: with the fits that calibrate an SVM, 2.4 KB a row three times over, which neither fits the memory
of many rows nor is read fast.  ``fit_svms`` keeps the prepared features (some 35 numbers a row) instead.
A pass makes the Fourier features of a few rows at a time, where they stay in the processor's cache, and
sums losses and gradients at points of all fits at once; besides the point that a line search asks for,
the ones that it would ask for next.

The fits are those of ``LinearSVC``: the same objective in the same scaled and centred features, the same
optimiser (Breeze's OWLQN without an L1 part and its backtracking search, written out in ``_minimise``), limit of
iterations and tolerance.  Sums are added up in another order, so results agree but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose Fourier features are made at once: 300 doubles each stay in the cache.
CACHED_ROWS = 256
#: Parts whose sums the driver adds up itself; more are added up in tasks first.
DRIVER_PARTS = 512
#: Steps of a line search that are tried beside the one asked for, as multiples of it, and the most steps it takes.
NEXT_STEPS = (2.1, 0.5)
SEARCH_STEPS = 20
#: Steps by which the optimiser knows the curvature.
HISTORY = 10

Point = tuple[float, np.ndarray]  # value and gradient


# ---------------------------------------------------------------- features in tasks

def _fourier(w: np.ndarray, b: np.ndarray):
    """cos(x W + b) of ``CACHED_ROWS`` rows or fewer, x with a column of ones, as a function that workers can run
    without this package. The result is overwritten by the next call."""
    turns = np.vstack([w, b]) / (2 * math.pi)
    # 2^(3/4) cos(pi f / 2) as a polynomial of f^2, f from -1/2 to 1/2; two doublings of the angle give cos(2 pi f)
    fit = np.polynomial.chebyshev.Chebyshev.interpolate(lambda u: 2 ** 0.75 * np.cos(math.pi / 2 * np.sqrt(u)), 6, domain=[0, 0.25])
    coefs = [float(c) for c in fit.convert(kind=np.polynomial.Polynomial).coef]
    root2, room = math.sqrt(2), []
    shape = CACHED_ROWS, w.shape[1]

    def cosines(x: np.ndarray) -> np.ndarray:
        if not room:
            room.extend((np.empty(shape), np.empty(shape)))
        z = np.matmul(x, turns, out=room[0][:len(x)])
        u = np.rint(z, out=room[1][:len(x)])
        z -= u
        z *= z
        np.multiply(z, coefs[-1], out=u)
        for c in coefs[-2:0:-1]:
            u += c
            u *= z
        u += coefs[0]
        u *= u
        u -= root2
        u *= u
        u -= 1
        return u
    return cosines


def _blocks(rows: DataFrame, fold: str, weight: str):
    """Features and a one, labels, weights and folds of the rows as a kept RDD of arrays' bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            if got.num_rows:
                x = np.column_stack([got.column(0).flatten().to_numpy().reshape(got.num_rows, -1), np.ones(got.num_rows)])
                parts = [a.tobytes() for a in (x, *(got.column(k).to_numpy() for k in (1, 2, 3)))]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["x", "y", "w", "f"])

    plain = rows.select(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double"), F.col(weight).cast("double"),
                        F.col(fold).cast("double"))
    return plain.mapInArrow(pack, "x binary, y binary, w binary, f binary").rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def _summed(blocks, add) -> np.ndarray:
    """``add(total or None, x, y, w, f)`` over a part's blocks, added up over all parts."""

    def part(held):
        total = None
        for block in held:
            y, w, f = (np.frombuffer(a) for a in block[1:])
            total = add(total, np.frombuffer(block[0]).reshape(len(y), -1), y, w, f)
        if total is not None:
            yield total

    sums = blocks.mapPartitions(part)
    return sums.treeReduce(lambda a, b: a + b) if blocks.getNumPartitions() > DRIVER_PARTS else sum(sums.collect())


def _moments(blocks, cosines, folds: int, size: int) -> np.ndarray:
    """Per fold: rows' weights and their squares summed up, then each feature and its square times the weight."""
    step = CACHED_ROWS

    def add(total, x, y, w, f):
        total = np.zeros((folds, 2 + 2 * size)) if total is None else total
        for k in range(0, len(y), step):
            z, own = cosines(x[k:k + step]), slice(k, k + step)
            in_fold = (f[own][:, None] == np.arange(folds)) * w[own][:, None]
            total[:, 0] += in_fold.sum(axis=0)
            total[:, 1] += (in_fold ** 2).sum(axis=0)
            total[:, 2:2 + size] += in_fold.T @ z
            total[:, 2 + size:] += in_fold.T @ (z * z)
        return total
    return _summed(blocks, add)


def _losses(blocks, cosines, points: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Per point (coefficients of the features, intercept last): loss, sum of its slopes, slopes times features."""
    step, coefs, start = CACHED_ROWS, np.ascontiguousarray(points[:, :-1].T), points[:, -1]

    def add(total, x, y, w, f):
        total = np.zeros((len(start), 2 + len(coefs))) if total is None else total
        sign = 2 * y - 1
        for k in range(0, len(y), step):
            z, own = cosines(x[k:k + step]), slice(k, k + step)
            part = sign[own][:, None]
            slack = 1 - part * (z @ coefs + start)
            weight = w[own][:, None] * (f[own][:, None] != left_out) * (slack > 0)
            total[:, 0] += (slack * weight).sum(axis=0)
            weight *= -part
            total[:, 1] += weight.sum(axis=0)
            total[:, 2:] += weight.T @ z
        return total
    return _summed(blocks, add)


# ---------------------------------------------------------------- the optimiser

class _Failed(Exception):
    """A line search that finds no step, or a history that gives no direction."""


def _direction(steps: list, deltas: list, grad: np.ndarray) -> np.ndarray:
    """The L-BFGS direction; latest step first."""
    out, shares, curves = grad.copy(), [], []
    for s, d in zip(steps, deltas):
        curves.append(s @ d)
        with np.errstate(all="ignore"):
            shares.append(np.divide(s @ out, curves[-1]))
        if math.isnan(shares[-1]):
            raise _Failed
        out -= shares[-1] * d
    if steps:
        if not curves[0] >= 0:
            raise _Failed
        out *= curves[0] / (deltas[0] @ deltas[0])
    for s, d, a, c in reversed([*zip(steps, deltas, shares, curves)]):
        out += (a - d @ out / c) * s
    out = -out
    return np.where(out * grad < 0, out, 0.0)  # as OWLQN corrects it


def _step(x, direction, at: Point, step: float, shrink: float) -> Generator[list, list, tuple]:
    """Breeze's backtracking line search under strong Wolfe conditions: the new point, its value and gradient.

    A coordinate doesn't go beyond zero in one step.  The search takes the value where it starts for that of its
    first step, which it thus shortens unseen, unless the slope is too flat to tell.
    """
    slope, side, known = at[1] @ direction, np.sign(np.where(x != 0, x, -at[1])), {}

    def moved(t: float) -> np.ndarray:
        there = x + t * direction
        return np.where(np.sign(there) == side, there, 0.0)

    for tries in range(SEARCH_STEPS):
        value = at[0]
        if tries or not value > value + step * slope * 1e-4:
            if step not in known:
                tried = [step, *(step * m for m in NEXT_STEPS)]
                known.update(zip(tried, (yield [moved(t) for t in tried])))
            new, grad = known[step]
            value, rise = new if tries else value, grad @ direction
        if value > at[0] + step * slope * 1e-4:
            factor = shrink
        elif rise < 0.9 * slope:
            factor = 2.1
        elif rise > -0.9 * slope:
            factor = shrink
        else:
            break
        if not 1e-10 <= step * factor <= 1e10:
            raise _Failed
        if tries < SEARCH_STEPS - 1:
            step *= factor
    return moved(step), known[step]


def _minimise(size: int, most: int, tol: float) -> Generator[list, list, np.ndarray]:
    """Yields lists of points, takes their values and gradients, and returns the last point reached."""
    x = np.zeros(size)
    (at,) = yield [x]
    first, values, steps, deltas, rounds, failed = at[0], [math.inf], [], [], 0, False
    while rounds < most and not np.linalg.norm(at[1]) <= max(tol * abs(at[0]), 1e-8):
        if len(values) >= 2 and abs(at[0] - max(values)) <= tol * first:
            break
        try:
            direction = _direction(steps, deltas, at[1])
            start, shrink = (0.5 / np.linalg.norm(at[1]), 0.1) if rounds < 1 else (1.0, 0.5)
            there, new = yield from _step(x, direction, at, start, shrink)
        except _Failed:
            if failed:
                break
            failed, steps, deltas = True, [], []
            continue
        steps, deltas = [there - x, *steps][:HISTORY], [new[1] - at[1], *deltas][:HISTORY]
        x, at, rounds, failed = there, new, rounds + 1, False
        values = [*values, at[0]][-20:]
    return x


# ---------------------------------------------------------------- fits

class _Problem:
    """One fit's objective in the scaled features that ``LinearSVC`` works in, on the rows not in fold ``left_out``."""

    def __init__(self, moments: np.ndarray, left_out: int, scale: float, reg: float):
        own = np.delete(moments, left_out, axis=0).sum(axis=0) if left_out >= 0 else moments.sum(axis=0)
        size = (len(own) - 2) // 2
        self.left_out, self.scale, self.reg, self.total = left_out, scale, reg, own[0]
        self.mean = scale * own[2:2 + size] / own[0]
        spread = np.maximum(scale ** 2 * own[2 + size:] / own[0] - self.mean ** 2, 0) * own[0]
        room = own[0] - own[1] / own[0]
        self.std = np.sqrt(spread / room) if room > 0 else np.zeros(size)
        self.inverse = np.divide(1, self.std, out=np.zeros(size), where=self.std != 0)

    def plain(self, point: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients of the features as they are, and the intercept."""
        coefs = point[:-1] * self.inverse
        return coefs, point[-1] - coefs @ self.mean

    def sent(self, point: np.ndarray) -> np.ndarray:
        coefs, intercept = self.plain(point)
        return np.append(coefs * self.scale, intercept)

    def value(self, point: np.ndarray, sums: np.ndarray) -> Point:
        own = point[:-1] * self.inverse ** 2
        slopes = self.inverse * (self.scale * sums[2:] - self.mean * sums[1])
        grad = np.append(slopes / self.total + self.reg * own, sums[1] / self.total)
        return sums[0] / self.total + 0.5 * self.reg * (own @ point[:-1]), grad


def fit_svms(rows: DataFrame, w: np.ndarray, b: np.ndarray, fold: str, weight: str, folds: int, reg: float, max_iter: int,
             tol: float) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept of the SVM of all rows, then of those without each fold's rows.

    ``rows``: ``features`` (before the Fourier map of ``w`` and ``b``), ``label`` 0 or 1, ``weight`` and
    ``fold`` (0..folds-1).  A pass over the rows is one job, whose tasks return some numbers for each point.
    """
    cosines, size = _fourier(w, b), w.shape[1]
    blocks = _blocks(rows, fold, weight)
    try:
        moments = _moments(blocks, cosines, folds, size)
        problems = [_Problem(moments, k, math.sqrt(2.0 / size), reg) for k in (-1, *range(folds))]
        runs = [_minimise(size + 1, max_iter, tol) for _ in problems]
        asked, found = {k: next(run) for k, run in enumerate(runs)}, {}
        while asked:
            points = [(problems[k], p) for k, some in asked.items() for p in some]
            sums = iter(_losses(blocks, cosines, np.array([o.sent(p) for o, p in points]), np.array([o.left_out for o, _ in points])))
            for k, some in list(asked.items()):
                try:
                    asked[k] = runs[k].send([problems[k].value(p, next(sums)) for p in some])
                except StopIteration as end:
                    found[k] = problems[k].plain(end.value)
                    del asked[k]
    finally:
        blocks.unpersist()
    return [found[k] for k in range(len(problems))]


def svm_model(spark: SparkSession, learner: LinearSVC, coefs: np.ndarray, intercept: float) -> LinearSVCModel:
    """The model that ``learner`` would return with these numbers."""
    sc = spark.sparkContext
    java = sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(learner.uid, _py2java(sc, Vectors.dense(coefs)), float(intercept))
    return learner._copyValues(LinearSVCModel(java))
