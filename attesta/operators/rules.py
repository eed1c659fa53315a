"""Rules and dependence: derived worlds by joins, closures by recursion over small edge tables or by frontier loops over large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.operators import kernel as K
from attesta.operators.tables import cut, drop

#: (head attribute, body attribute) of the rules of the schema.
EDGES = (("work_city", "employer"), ("work_city", "hq_city"), ("tax_zone", "work_city"), ("tax_zone", "birthplace"), ("office", "employer"))
MAX_DEPTH = 8


def rule_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "head string, body string")


def family_rows(inter: DataFrame, day: int) -> DataFrame:
    """entity, attr, world: a row per candidate world of each key."""
    k = inter.where("not limited")
    return k.select("entity", "attr", F.explode_outer(F.expr(K.family(str(day)))).alias("world"))


def head_offices(supplier: DataFrame, reports: int = 5) -> DataFrame:
    """v, c: the candidate cities of each company, from its first reports."""
    v = F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string"))
    w = Window.partitionBy("v").orderBy("s_suppkey")
    s = supplier.select(v.alias("v"), "s_suppkey", F.concat(F.lit("c"), (F.col("s_nationkey") % 4).cast("string")).alias("c")).withColumn("n", F.row_number().over(w))
    return s.where(F.col("n") <= reports).select("v", "c").distinct()


def lookup_rule(family: DataFrame, second: DataFrame) -> DataFrame:
    """entity, via, city: head worlds of a rule of two literals; a missing value in either gives the empty world."""
    hq = second.select(F.col("v").alias("world"), "c")
    return family.join(hq, "world", "left").select("entity", F.col("world").alias("via"), F.coalesce("c", F.lit("")).alias("city")).distinct()


def cross_union(one: DataFrame, two: DataFrame, a: str, b: str) -> DataFrame:
    """entity, world: unions of every world of one rule with every world of the other, entity by entity."""
    met = one.join(two, "entity", "full")
    parts = F.filter(F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))), lambda x: x != "")
    return met.select("entity", F.array_join(F.array_sort(F.array_distinct(parts)), "+").alias("world")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """head, body, depth, base of all paths of the (acyclic) rules; refused beyond MAX_DEPTH."""
    edges.createOrReplaceTempView("rule_edges_of_closure")
    return edges.sparkSession.sql(
        f"""WITH RECURSIVE c(head, body, depth) AS (SELECT head, body, 1 FROM rule_edges_of_closure
            UNION ALL SELECT c.head, e.body, c.depth + 1 FROM c JOIN rule_edges_of_closure e ON e.head = c.body WHERE c.depth <= {MAX_DEPTH})
            SELECT head, body, max(depth) AS depth, body NOT IN (SELECT head FROM rule_edges_of_closure) AS base FROM c GROUP BY head, body"""
    )


def overlaps(edges: DataFrame) -> DataFrame:
    """head, x, y: literals of one head whose base closures meet, so that joining their worlds would not be exact."""
    base = closure(edges).where("base").select(F.col("head").alias("x"), F.col("body").alias("b"))
    own = edges.join(edges.select("head").distinct().withColumnRenamed("head", "body"), "body", "left_anti").select(F.col("body").alias("x"), F.col("body").alias("b"))
    reads = base.unionByName(own).distinct()
    lit = edges.select("head", F.col("body").alias("x")).join(reads, "x")
    other = lit.select("head", F.col("x").alias("y"), "b")
    return lit.join(other, ["head", "b"]).where("x < y").select("head", "x", "y").distinct()


def dependents(family: DataFrame, changed: DataFrame) -> DataFrame:
    """head_entity of the heads that may read a changed key through a value of theirs."""
    return family.join(changed.select(F.col("changed").alias("world")), "world", "left_semi").select(F.col("entity").alias("head_entity")).distinct()


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: everything reachable from the seeds along src -> dst. One join per level; seen nodes are left out, so cycles end."""
    edges = cut(edges)
    seen = cut(seeds.distinct())
    frontier = seen
    while True:
        new = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        new = cut(new)
        if not new.limit(1).count():
            return seen
        grown = cut(seen.unionByName(new))
        drop(seen)
        if frontier is not seen:
            drop(frontier)
        seen, frontier = grown, new


def chain_lengths(edges: DataFrame) -> DataFrame:
    """root, chain: the number of edges from each src (which has one dst) to the end of its path. Pointers double in length with each
    round, so a round is one self-join of as many rows as there are edges, and the paths themselves are never written out."""
    done, now = None, cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("at"), F.lit(1).cast("long").alias("chain")))
    while True:
        ahead = now.select(F.col("root").alias("at"), F.col("at").alias("far"), F.col("chain").alias("more"))
        ended = done.select(F.col("root").alias("at"), F.lit(None).cast(now.schema["at"].dataType).alias("far"), F.col("chain").alias("more")) if done is not None else None
        met = now.join(ahead if ended is None else ahead.unionByName(ended), "at", "left")
        new = cut(met.select("root", F.col("far").alias("at"), (F.col("chain") + F.coalesce("more", F.lit(0))).alias("chain")))
        drop(now)
        over = new.where("at is null").select("root", "chain")
        done = over if done is None else done.unionByName(over)
        now = cut(new.where("at is not null"))
        if not now.limit(1).count():
            return done


def components(edges: DataFrame) -> DataFrame:
    """attr, component (its least attribute) over undirected rule edges; a table of attributes is small."""
    both = cut(edges.select(F.col("head").alias("x"), F.col("body").alias("y")).unionByName(edges.select(F.col("body").alias("x"), F.col("head").alias("y"))))
    now = cut(both.select(F.col("x").alias("attr"), F.col("x").alias("component")).distinct())
    while True:
        near = both.join(now, both.y == now.attr).select(F.col("x").alias("attr"), "component")
        new = cut(now.unionByName(near).groupBy("attr").agg(F.min("component").alias("component")))
        same = not new.exceptAll(now).limit(1).count()
        drop(now)
        now = new
        if same:
            return now
