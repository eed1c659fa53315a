"""Mixing sources to target weights.

Sizes (words) are summed per source; weights share a given multiple of all sizes, each source capped at
``max_repeats`` times its own size and the excess shared again by weight. The repetition rate of a source is its
target over its size; each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the
fraction of the rate: a hash of its id, a place on a circle of ``CIRCLE``, falls into an arc that is the fraction of the circle.
Where the arc begins is the seed of the source: of ``SEEDS`` places, that from which the words so taken come closest to the target, found
from the source's histogram of (place, words).

Nulls: a null text has size 0, a null source is a source of its own, last in order; a null id draws the number of the word
null. Repeated rows share an id and so a draw. An empty table gives no rows. Other columns of any name pass through. Nothing but sums per source and
place is shuffled, and the table of sources, which has one row each, is ordered in one task; beyond ``BROADCAST_BYTES`` it is not broadcast,
but the largest ``HEAD`` sources are, so that the rows of a hot source stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash32, table, words

CIRCLE, SEEDS = 16384, 64
WEIGHTS = (3, 1, 2)
#: Size of the table of rates up to which it is broadcast, and the number of largest sources that are broadcast beyond.
BROADCAST_BYTES, HEAD = 32 << 20, 1000


def sized(docs: DataFrame) -> DataFrame:
    """The documents with their size, source key and place on the circle in columns of their own names."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        words(F.col("text")).alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("key"),
        (hash32(F.col("doc_id"), "mix") % CIRCLE).cast("int").alias("at"),
    )


def rates(docs: DataFrame, weights=WEIGHTS, share_pct: int = 150, max_repeats: int = 2) -> DataFrame:
    """key, source_size, target, copies (floor of the rate), arc (places of the fraction) and seed (where the arc begins)."""
    hist = sized(docs).groupBy("key", "at").agg(F.sum("size").alias("words"))
    by = hist.groupBy("key").agg(F.sum("words").alias("source_size"))
    # the key "n" of the null source sorts before "s..."; null goes last
    order = Window.orderBy((F.col("key") == "n").cast("int"), "key")
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    # A source is capped from the level cap / weight on: with the sources in the order of those levels, the level
    # that uses up the budget is found from running sums. All sums are of integers, so order cannot change them.
    level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by = by.withColumns({
        "budget": F.sum("source_size").over(every) * share_pct,
        "before": F.coalesce(F.sum("cap").over(upto), F.lit(0)) * 100,
        "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
    })
    by = by.withColumn("free", F.col("cap").cast("decimal(20,0)") * F.col("left") * 100 >= (F.col("budget") - F.col("before")).cast("decimal(20,0)") * F.col("weight"))
    first = by.where("free").agg(F.min_by(F.struct("budget", "before", "left"), F.struct(F.col("cap") / F.col("weight"), "key")).alias("at"))
    by = by.crossJoin(F.broadcast(first)).withColumn(
        "target",
        F.when(F.col("free"), F.col("weight") * (F.col("at.budget") - F.col("at.before")).cast("double") / (F.col("at.left") * 100)).otherwise(F.col("cap").cast("double")),
    )
    by = by.withColumn("copies", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int"))
    by = by.withColumn("missing", F.col("target") - F.col("copies") * F.col("source_size"))
    by = by.withColumn("arc", F.coalesce(F.round(F.try_divide("missing", "source_size") * CIRCLE), F.lit(0)).cast("int")).select("key", "source_size", "target", "copies", "missing", "arc")
    # the words that each seed would take, summed in one pass over the histogram
    seed = [F.coalesce(F.sum(F.when(F.pmod(F.col("at") - F.lit(i * CIRCLE // SEEDS), F.lit(CIRCLE)) < F.col("arc"), F.col("words"))), F.lit(0)) for i in range(SEEDS)]
    took = hist.join(by, "key").groupBy("key", "missing").agg(F.array(*seed).alias("took"))
    off = F.transform("took", lambda t, i: F.struct(F.abs(t - F.col("missing")).alias("off"), (i * (CIRCLE // SEEDS)).alias("seed")))
    return by.join(took.select("key", F.array_min(off)["seed"].alias("seed")), "key").select("key", "source_size", "target", "copies", "arc", "seed")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """row (struct of the document), size, source_size, target, copies of each document."""
    by, rows = cut(rates(docs, **how)), sized(docs)
    size = by.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(by), "key")
    else:
        head = cut(by.orderBy(F.desc("source_size"), "key").limit(HEAD))
        tail = by.join(F.broadcast(head.select("key")), "key", "left_anti")
        out = rows.join(F.broadcast(head), "key").unionByName(rows.join(F.broadcast(head.select("key")), "key", "left_anti").join(tail, "key"))
    drawn = F.pmod(F.col("at") - F.col("seed"), F.lit(CIRCLE)) < F.col("arc")
    return out.select("row", "size", "source_size", "target", (F.col("copies") + drawn.cast("int")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    out = mixed(docs, **how).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")


def op9_mix(spark, sf_dir):
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce('s' || source, 'n') AS key,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT % 16384)::INTEGER AS place
  FROM documents),
h AS (SELECT key, place, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2),
s AS (SELECT key, CAST(sum(words) AS BIGINT) AS source_size FROM h GROUP BY 1),
w AS (SELECT key, source_size, 2 * source_size AS cap,
             ([3, 1, 2])[((row_number() OVER (ORDER BY (key = 'n')::INT, encode(key)) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
-- the level t at which sum(min(cap, t * weight)) meets the budget is found by trying every set of capped sources that a level can give
lv AS (SELECT a.key, a.cap::DOUBLE / a.weight AS ratio,
              (SELECT CAST(coalesce(sum(b.cap), 0) AS BIGINT) FROM w b WHERE (b.cap::DOUBLE / b.weight, encode(b.key)) < (a.cap::DOUBLE / a.weight, encode(a.key))) AS capped,
              (SELECT CAST(sum(b.weight) AS BIGINT) FROM w b WHERE (b.cap::DOUBLE / b.weight, encode(b.key)) >= (a.cap::DOUBLE / a.weight, encode(a.key))) AS open,
              a.cap, a.weight FROM w a),
t AS (SELECT *, cap::HUGEINT * open * 100 >= ((SELECT sum(source_size) FROM s) * 150 - capped * 100) * weight AS free FROM lv),
f AS (SELECT (SELECT CAST(sum(source_size) AS BIGINT) FROM s) * 150 - capped * 100 AS rest, open FROM t WHERE free ORDER BY ratio, encode(key) LIMIT 1),
g AS (SELECT w.key, w.source_size, CASE WHEN t.free THEN w.weight * (f.rest::DOUBLE) / (f.open * 100) ELSE w.cap::DOUBLE END AS target
      FROM w JOIN t USING (key), f),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::INT END AS copies FROM g),
m AS (SELECT *, target - copies * source_size AS missing, CASE WHEN source_size = 0 THEN 0 ELSE round((target - copies * source_size) / source_size * 16384)::INT END AS arc FROM r),
c AS (SELECT m.key, seed * 256 AS seed, coalesce(sum(words) FILTER ((place - seed * 256 + 16384) % 16384 < arc), 0) AS took, any_value(missing) AS missing
      FROM m JOIN h USING (key), range(64) s(seed) GROUP BY 1, 2),
b AS (SELECT key, arg_min(seed, {'off': abs(took - missing), 'seed': seed}) AS seed FROM c GROUP BY 1)
SELECT d.doc_id, d.size::BIGINT AS size, m.source_size, m.target,
       ((m.copies + ((d.place - b.seed + 16384) % 16384 < m.arc)::INT) * d.size)::BIGINT AS taken, (m.copies + ((d.place - b.seed + 16384) % 16384 < m.arc)::INT)::INT AS copies
FROM d JOIN m USING (key) JOIN b USING (key)
"""
