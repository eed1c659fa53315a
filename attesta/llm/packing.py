"""Packing into token-budget batches of optimal length buckets.

The lengths of all documents are counted into one histogram. Dynamic programming over it chooses at most ``buckets`` upper
bounds that minimise padding, the sum over documents of the bound of their bucket less their length. Inside a bucket the
documents are numbered without gaps and every ``budget // bound`` of them form a batch, so the padded batch keeps
to the token budget; a document longer than the budget is a batch of its own, whole.

The histogram has one row per length and reaches the driver whole and exact: m different lengths take at least m * (m - 1) / 2 words
of text, so there are fewer than 175,000 in 30 GB of text. A round of the programme is m log m in NumPy. Numbering adds a row's place in its (bucket, cell) to the rows of earlier cells: no task
sorts a whole bucket. Nulls: a null text has length 0 (bucket of the shortest); repeated rows are packed as often as they
come; an empty table gives no rows; other columns of any name are ignored. The text itself is never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash32, table, words

BUCKETS, BUDGET = 12, 8192
#: Rows of a cell of a bucket, of which one task numbers some; and its fewest cells.
CELL_ROWS, CELLS = 200_000, 64
#: More than any padding; twice as much still fits 64 bits.
_MUCH = 1 << 62


def bounds(lengths: np.ndarray, n: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds (each one of ``lengths``, which ascend) of at most ``buckets`` ranges with the least padding.
    With more bounds than needed, the fewest are returned."""
    m = len(lengths)
    if m == 0:
        return []
    rows, tokens = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * lengths)]
    best = np.full(m + 1, _MUCH, dtype=np.int64)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, _MUCH, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0

        # the best cut moves up with the end: divide and conquer over ends, each with the range its cut can lie in; one level at a time
        lo, hi, a, b = (np.array([x]) for x in (1, m, 0, m - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(b, j - 1) - a + 1
            first = np.cumsum(size) - size
            at = np.repeat(np.arange(len(j)), size)
            i = np.arange(len(at)) + (a - first)[at]
            cost = best[i] + lengths[j - 1][at] * (rows[j][at] - rows[i]) - (tokens[j][at] - tokens[i])
            low = np.minimum.reduceat(cost, first)
            hit = np.flatnonzero(cost == low[at])
            k = i[hit[np.searchsorted(hit, first)]]
            new[j], cut[j] = low, k
            lo, hi, a, b = np.r_[lo, j + 1], np.r_[j - 1, hi], np.r_[a, k], np.r_[k, b]
            lo, hi, a, b = (x[lo <= hi] for x in (lo, hi, a, b))
        back.append(cut)
        if new[m] >= best[m]:
            back.pop()
            break
        best = new
    out, j = [], m
    for cut in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(out)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, tokens, bucket (from 0), bound, batch (in the bucket), place (in the batch), padding of each row."""
    # the words of a text are counted once: what follows reads ids and counts
    rows = cut(docs.select("doc_id", words(F.col("text")).alias("tokens")))
    sizes = rows.groupBy(F.col("tokens").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").toPandas()
    cells = max(CELLS, int(sizes["n"].sum()) // CELL_ROWS)
    rows = rows.withColumn("cell", (hash32(F.col("doc_id"), "pack") % cells).cast("int"))
    tops = bounds(sizes["length"].to_numpy(dtype=np.int64), sizes["n"].to_numpy(dtype=np.int64), buckets) or [0]
    place = F.lit(len(tops) - 1)
    for i in range(len(tops) - 2, -1, -1):
        place = F.when(F.col("tokens") <= tops[i], i).otherwise(place)
    rows = rows.withColumn("bucket", place).withColumn("bound", F.get(F.array(*[F.lit(t).cast("long") for t in tops]), F.col("bucket")))
    each_cell = rows.groupBy("bucket", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each_cell = each_cell.select("bucket", "cell", before.alias("before"))  # a row for about CELL_ROWS documents
    at = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy("doc_id", "tokens"))
    out = rows.withColumn("at", at).join(F.broadcast(each_cell), ["bucket", "cell"]).withColumn("number", F.col("before") + F.col("at") - 1)
    each = F.greatest(F.lit(1), F.floor(budget / F.greatest("bound", F.lit(1)))).cast("long")
    return out.select(
        "doc_id", "tokens", "bucket", "bound", F.floor(F.col("number") / each).alias("batch"), (F.col("number") % each).alias("place"), (F.col("bound") - F.col("tokens")).alias("padding")
    )


def op7_length_buckets(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
