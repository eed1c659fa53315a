"""Queries against blocks of rows: the shape of the two vector searches.

Rows are cut into blocks by a hash of the id, so many that a block holds about ``NUMBERS`` components. A block is one partition: its rows
come first and are indexed once, the queries stream past the index after them, batch by batch. So a task holds one block and
one batch, whatever the data, and a row is shuffled once. Where there are fewer blocks than cores, queries are cut as
well (``parts``), and each part has its own copy of the block. Every block answers with the best of its rows for each
query, and the best of all blocks are ranked, after a rank limit ahead of the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Components of the rows of a block; queries that are worth a part of their own.
NUMBERS, PART = 1 << 22, 64


def search(vectors: DataFrame, vec: str, query: Column, k: int, score: str, index: Callable, numbers: int = NUMBERS) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` has vec_id and ``vec`` (array); those with ``query`` are asked for among all. Only vectors
    of equal length are compared, and never those of equal vec_id; a repeated row counts once. ``index(ids, matrix)`` is built for the
    rows of a block, in order of id, and called with (id, vector, k) of a query to give row numbers and scores, best first."""
    spark = vectors.sparkSession
    size, m = vectors.agg(F.coalesce(F.sum(F.size(vec)), F.lit(0)), F.count_if(query)).first()
    many = max(1, -(-size // numbers))
    parts = max(1, min(-(-2 * spark.sparkContext.defaultParallelism // many), -(-m // PART)))
    rb = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(many)).cast("int")
    qb = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    as_row = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda q: F.struct((rb * parts + q).alias("cell"), F.lit(0).alias("asks")))
    as_query = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda b: F.struct((b * parts + qb).alias("cell"), F.lit(1).alias("asks")))
    at = F.explode(F.when(query, F.concat(as_row, as_query)).otherwise(as_row))
    laid = vectors.select(at.alias("at"), F.size(vec).alias("dim"), "vec_id", F.col(vec).alias("v")).select("at.cell", "dim", "at.asks", "vec_id", "v")
    laid = laid.repartitionById(many * parts, F.col("cell")).sortWithinPartitions("cell", "dim", "asks", "vec_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, rows, probe, asked = None, [], [], None, set()
        for pdf in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            for (cell, dim, asks), part in pdf.groupby(["cell", "dim", "asks"], sort=True):
                if (cell, dim) != key:
                    key, ids, rows, probe = (cell, dim), [], [], None
                new, vecs = part["vec_id"].to_numpy(dtype=np.int64), np.stack(part["v"].to_numpy()) if dim else np.zeros((len(part), 0))
                if not asks:
                    ids.append(new)
                    rows.append(vecs)
                    continue
                if probe is None:
                    own, x = distinct(np.concatenate(ids), np.concatenate(rows))
                    probe, ids, rows = index(own, x), [], []
                for qid, q in zip(*distinct(new, vecs), strict=True):
                    if (cell, dim, qid, q.tobytes()) in asked:
                        continue
                    hits, scores = probe(qid, q, k)
                    out["query_id"].append(np.full(len(hits), qid))
                    out["vec_id"].append(own[hits])
                    out["score"].append(scores)
                # queries come in order of id: a repeated one can only go on from the last id of a batch
                asked = {(cell, dim, i, v.tobytes()) for i, v in zip(new.tolist(), vecs, strict=True) if i == new[-1]} | {x for x in asked if x[2] == new[-1]}
            yield pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for c, v in out.items()})

    met = laid.mapInPandas(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of id, each (id, vector) once."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if len(ids) < 2 or (ids[1:] > ids[:-1]).all():
        return ids, x
    seen, keep = set(), []
    for i, (a, v) in enumerate(zip(ids.tolist(), x, strict=True)):
        if (a, v.tobytes()) not in seen:
            seen.add((a, v.tobytes()))
            keep.append(i)
    return ids[keep], x[keep]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties to the smaller place."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= edge)
    else:
        pick = np.arange(len(scores))
    return pick[np.argsort(-scores[pick], kind="stable")][:k]


def usable(column, extra=None):
    """Whether an array is there and all its components are finite."""
    ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok if extra is None else ok & extra, F.lit(False))
