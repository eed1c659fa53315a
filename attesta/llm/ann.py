"""Approximate nearest neighbours by collision counting.

Largest inner product is turned into least distance: vectors are put into classes of like length, and in each a vector x gets one
coordinate more, so that all of the class have the class's greatest length; then the nearest to a query are those of
largest product. Classes are cut between the powers of ``RATIO``, so vectors scaled to one length are of one class in spite of rounding.
Every vector is projected on the axes of random rotations, and for each projection the values are kept as one sorted array.
A query opens a window around its own value in every array; a vector inside it collides. Windows widen by a constant factor
(virtual rehashing: a wider window only adds the entries between its old and new ends) until enough vectors have collided in ``ALPHA`` of
the projections; those are verified by their exact product. The first width comes from a bounded sample of the class; it decides where
widening begins, not what is found. Where a window holds most of an array, the entries outside it are counted instead.

A class of n vectors of a row block is searched until ``SPARE`` times ``k`` plus ``BETA`` of n have collided, whatever n; the best of all
blocks are merged. Measured recall is in the README. Nulls: vectors that are null, zero, or hold null or non-finite components
take no part, nor do null ids; a repeated row counts once; of an id with several vectors each is a row. Lengths are taken
on vectors scaled by their greatest component, so none that is finite over- or underflows; products that overflow are infinite, and
one of infinities of both signs ranks last. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .blocks import best, search, usable
from .common import table

PROJECTIONS, ALPHA, BETA, SPARE = 64, 0.9, 0.1, 8
#: Factor by which windows widen, sample that sets the first, and ratio of lengths within a class.
WIDEN, SAMPLE, RATIO = 1.15, 256, 1.1


def axes(dim: int, projections: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """dim x m unit vectors: the axes of as many random rotations as give ``projections``."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.concatenate(turns, axis=1)[:, :projections]


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and logarithms of lengths of the rows of ``x``, none of them zero."""
    most = np.abs(x).max(axis=1)
    part = x / most[:, None]
    rest = np.sqrt((part * part).sum(axis=1))
    return part / rest[:, None], np.log(most) + np.log(rest)


class Sorted:
    """The sorted arrays of one class."""

    def __init__(self, points: np.ndarray):
        self.n, dim = points.shape
        self.axes = axes(dim)
        self.values = np.ascontiguousarray((points @ self.axes).T)
        self.order = np.argsort(self.values, axis=1, kind="stable").astype(np.int32)
        self.need = int(np.ceil(ALPHA * len(self.values)))
        step = max(1, self.n // SAMPLE)
        self.sample = self.values[:, ::step][:, :SAMPLE].copy()
        self.values = np.take_along_axis(self.values, self.order.astype(np.int64), axis=1)

    def first(self, at: np.ndarray, share: float) -> float:
        """Half width at which about ``share`` of the sample collides often enough."""
        off = np.abs(self.sample - at[:, None])
        reach = np.partition(off, self.need - 1, axis=0)[self.need - 1]
        return float(np.partition(reach, k := min(len(reach) - 1, int(share * len(reach))))[k]) or 1e-12

    def candidates(self, at: np.ndarray, many: int) -> np.ndarray:
        """Rows that collide in at least ALPHA of the arrays, at the first width at which these are ``many``. A width of twice the
        greatest distance holds all rows, so widening ends."""
        w = self.first(at, many / self.n)
        n, m = self.n, len(self.values)
        count = np.zeros(n, dtype=np.int16)
        full = 0
        lo = [int(np.searchsorted(v, x - w)) for v, x in zip(self.values, at, strict=True)]
        hi = [int(np.searchsorted(v, x + w, side="right")) for v, x in zip(self.values, at, strict=True)]
        for j in range(m):
            o = self.order[j]
            if 2 * (hi[j] - lo[j]) > n:
                full += 1
                count[o[: lo[j]]] -= 1
                count[o[hi[j] :]] -= 1
            else:
                count[o[lo[j] : hi[j]]] += 1
        while True:
            found = np.flatnonzero(count >= self.need - full)
            if len(found) >= min(many, n):
                return found
            w *= WIDEN
            for j in range(m):
                a, b = int(np.searchsorted(self.values[j], at[j] - w)), int(np.searchsorted(self.values[j], at[j] + w, side="right"))
                o = self.order[j]
                count[o[a : lo[j]]] += 1
                count[o[hi[j] : b]] += 1
                lo[j], hi[j] = a, b


class Collisions:
    """The classes of a row block, each with its sorted arrays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x.astype(np.float64)
        unit, size = scaled(self.x)
        kind = np.floor(size / np.log(RATIO) + 0.5).astype(np.int64)
        self.classes = []
        for c in np.unique(kind):
            rows = np.flatnonzero(kind == c)
            share = np.exp(size[rows] - size[rows].max())
            more = np.sqrt(np.maximum(0.0, 1 - share * share))
            self.classes.append((rows, Sorted(np.column_stack([unit[rows] * share[:, None], more]))))

    def __call__(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float64)
        at = np.append(scaled(q[None, :])[0][0], 0.0)
        hit = [rows[index.candidates(at @ index.axes, SPARE * k + int(np.ceil(BETA * len(rows))))] for rows, index in self.classes]
        hit = np.sort(np.concatenate(hit))
        hit = hit[self.ids[hit] != qid]
        with np.errstate(over="ignore", invalid="ignore"):
            score = (self.x[hit] * q).sum(axis=1)
        pick = best(np.where(np.isnan(score), -np.inf, score), k)
        return hit[pick], score[pick]


def nearest(vectors, vec: str, query, k: int, **how):
    """query_id, rank, vec_id, score of the ``k`` nearest found; see ``blocks.search``."""
    v = F.col(vec).cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v"), query.alias("query")).where(usable(F.col("v"), F.exists("v", lambda x: x != 0)) & F.col("vec_id").isNotNull())
    return search(rows, "v", F.col("query"), k, "double", Collisions, **how)


def op1_collision_counting(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id") % 20 == 0, 20)
