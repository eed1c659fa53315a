"""Exact top-k by inner product: norm-bucketed retrieval.

The vectors of a row block are ordered by length and cut into buckets of like length. For a query the buckets are visited from
the longest; its k-th best product so far over the lengths of the query and of the bucket's longest vector is the cosine that a
vector of the bucket must reach (the local threshold). Beyond 1 the search ends: no shorter vector can do better.
Else the bucket is pruned either by length (only vectors long enough to reach the product at cosine 1) or by a coordinate: the angle
between two vectors bounds how far apart their angles to an axis are, so the wanted vectors lie in a range of the bucket's sorted
list for each of the query's largest coordinates. Whichever leaves fewer is chosen per query and bucket, and what is left is verified by whole products
of integers. All bounds are taken with a small slack, so the result is exact.

Components become floor(1024 * x) as long (saturated beyond its range). Nulls: vectors that are null or hold null or non-finite
components take no part, nor do null ids; zero and empty vectors do, with product 0. A repeated row counts once; of an id with
several vectors each is a row. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .blocks import best, search, usable
from .common import table

BUCKET, RATIO, FOCUS, SLACK = 2048, 0.9, 4, 1e-9


class Bucket:
    """Vectors ``rows`` of like length, longest first, with the sorted lists of their unit coordinates."""

    def __init__(self, x: np.ndarray, size: np.ndarray, rows: np.ndarray):
        self.rows, self.size, self.top = rows, size[rows], float(size[rows[0]])
        self.x = x[rows]
        unit = self.x / np.maximum(self.size, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.ascontiguousarray(np.take_along_axis(unit, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    def left(self, unit: np.ndarray, focus: np.ndarray, length: float, need: float) -> np.ndarray | None:
        """Places in the bucket that can reach product ``need`` with the query; None: all."""
        if need <= 0 or length == 0:
            return None
        cos = need / (length * self.top) - SLACK
        if cos > 1:
            return np.zeros(0, dtype=np.int64)
        long_enough = int(np.searchsorted(-self.size, -(need / length) * (1 - SLACK), side="right"))
        angle = np.arccos(np.clip(cos, -1, 1)) + 1e-7
        most, pick = long_enough, None
        for f in focus:
            own = np.arccos(np.clip(unit[f], -1, 1))
            low, high = np.cos(min(np.pi, own + angle)) - SLACK, np.cos(max(0.0, own - angle)) + SLACK
            a, b = np.searchsorted(self.values[f], low), np.searchsorted(self.values[f], high, side="right")
            if b - a < most:
                most, pick = int(b - a), (f, int(a), int(b))
        if pick is None:
            return np.arange(long_enough)
        f, a, b = pick
        got = self.order[f, a:b]
        return got[got < long_enough]


class Buckets:
    """The buckets of a row block, longest vectors first. Products are of integers, in double where none can exceed 2**53."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.far = max(1.0, float(np.abs(x).max(initial=0))) * max(1, x.shape[1])
        self.exact = {}
        xf = x.astype(np.float64)
        size = np.sqrt((xf * xf).sum(axis=1))
        order = np.argsort(-size, kind="stable")
        self.buckets, at = [], 0
        while at < len(order):
            end = at + int(np.searchsorted(-size[order[at : at + BUCKET]], -RATIO * size[order[at]], side="right"))
            self.buckets.append(Bucket(xf, size, order[at:end]))
            at = end

    def rows_for(self, q: np.ndarray) -> np.ndarray:
        """The rows in a type in which products with ``q`` are exact."""
        far = self.far * max(1.0, float(np.abs(q).max(initial=0)))
        kind = np.float64 if far < 2**53 else np.int64 if far < 2**63 else object
        if kind not in self.exact:
            self.exact[kind] = self.x.astype(kind)
        return self.exact[kind]

    def __call__(self, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        exact = self.rows_for(q)
        exact_q, qf = q.astype(exact.dtype), q.astype(np.float64)
        length = float(np.sqrt((qf * qf).sum()))
        unit = qf / max(length, 1e-300)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        hits, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=exact.dtype)
        for b in self.buckets:
            need = float(scores[k - 1]) if len(scores) >= k else -np.inf
            if need > 0 and length * b.top * (1 + SLACK) < need:
                break
            left = b.left(unit, focus, length, need)
            rows = b.rows if left is None else b.rows[left]
            rows = rows[self.ids[rows] != qid]
            if not len(rows):
                continue
            hits, scores = np.concatenate([hits, rows]), np.concatenate([scores, exact[rows] @ exact_q])
            order = np.argsort(hits, kind="stable")  # rows are in order of id, so ties go to the smaller id
            hits, scores = hits[order], scores[order]
            pick = best(scores, k) if scores.dtype != object else np.array(sorted(range(len(scores)), key=lambda j: -scores[j])[:k], dtype=np.int64)
            hits, scores = hits[pick], scores[pick]
        return hits, np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], dtype=np.int64)


def top(vectors, vec: str, query, k: int, **how):
    """query_id, rank, vec_id, score of the ``k`` highest products of integers (``vec`` is an array of long); see ``blocks.search``."""
    return search(vectors.select("vec_id", F.col(vec).alias("v"), query.alias("query")), "v", F.col("query"), k, "long", Buckets, **how)


def op5_norm_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long")).alias("v"))
    return top(rows, "v", F.col("vec_id") % 100 == 0, 10)


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(q.v) = len(r.v)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM n WHERE rank <= 10
"""
