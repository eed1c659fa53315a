"""Policy: scores of candidates and the decision on each answer. Only ``CASE`` chains and grouped aggregates over supports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORS = {"trusted": 2.2, "standard": 1.2, "low": 0.3}
UNKNOWN_PRIOR, BIAS, P_MAX, TIE = 0.5, 0.5, 1.0 - 1e-9, 1e-12


@dataclass(frozen=True)
class Policy:
    name: str
    abstain: float
    ask: float
    recency: bool = False


PRESETS = (Policy("justified", 0.0, 1.0), Policy("recency", 0.0, 0.5, True), Policy("lww", 0.0, 0.0, True), Policy("abstain", 1.0, 1.0))


def prior_of(source_class: Column) -> Column:
    out = F.lit(UNKNOWN_PRIOR)
    for k, v in PRIORS.items():
        out = F.when(source_class == k, v).otherwise(out)
    return out


def supporting(piece: DataFrame) -> DataFrame:
    """entity, attr, cand, rid, lsn, grp, source_class of every report in a support of a candidate; candidates without support have one
    row of nulls. ``piece`` has ``sup`` and ``reps``; one piece per key."""
    s = piece.select("entity", "attr", "reps", F.explode_outer("sup").alias("s"))
    ids = F.expr("array_distinct(flatten(transform(s.envs, e -> split(e, ','))))")
    r = s.select("entity", "attr", F.when(F.col("s.world") == "", "(empty)").otherwise(F.col("s.world")).alias("cand"), F.explode_outer(F.filter("reps", lambda p: F.array_contains(ids, p["rid"]))).alias("p"))
    return r.select("entity", "attr", "cand", "p.rid", "p.lsn", "p.grp", "p.source_class")


def group_weights(sup: DataFrame) -> DataFrame:
    """entity, attr, cand, grp, weight: the largest prior of each origin group behind a candidate."""
    return sup.where("rid is not null").groupBy("entity", "attr", "cand", "grp").agg(F.max(prior_of(F.col("source_class"))).alias("weight"))


def scores(sup: DataFrame) -> DataFrame:
    """entity, attr, cand, score, newest, groups of each candidate."""
    # one pass: ``sup`` is not made a second time for the weights
    weight = F.max(F.when(F.col("rid").isNotNull(), prior_of(F.col("source_class")))).alias("weight")
    each = sup.groupBy("entity", "attr", "cand", "grp").agg(weight, F.max("lsn").alias("newest"))
    by = each.groupBy("entity", "attr", "cand").agg(F.max("newest").alias("newest"), F.count("grp").alias("groups"), F.round(F.sum("weight"), 6).alias("pro"))
    all_ = by.na.fill({"pro": 0.0, "newest": -1})
    con = F.round(F.sum("pro").over(Window.partitionBy("entity", "attr")) - F.col("pro"), 6)
    x = F.col("pro") - con + F.when(con == 0, BIAS).otherwise(0.0)
    return all_.select("entity", "attr", "cand", F.round(F.least(1 / (1 + F.exp(-x)), F.lit(P_MAX)), 9).alias("score"), "newest", "groups")


def select(scored: DataFrame, recency: bool) -> DataFrame:
    """entity, attr, chosen (null on an exact tie), p, n of each key."""
    w = Window.partitionBy("entity", "attr")
    key = F.col("newest").cast("double") if recency else F.col("score")
    order = w.orderBy(F.desc("key"), "cand")
    r = scored.withColumn("key", key).withColumns({"rn": F.row_number().over(order), "next": F.lead("key").over(order), "top": F.max("score").over(w), "n": F.count(F.lit(1)).over(w)})
    tie = F.coalesce(F.abs(F.col("next") - F.col("key")) <= TIE, F.lit(False))
    p = F.when(tie, F.col("top")).otherwise(F.col("score")) if recency else F.col("score")
    return r.where("rn = 1").select("entity", "attr", F.when(~tie, F.col("cand")).alias("chosen"), p.alias("p"), "n")


def decide(status: DataFrame, scored: DataFrame, policy: Policy) -> DataFrame:
    """entity, attr, status, decision, assertion of each key; ``status`` has the candidates."""
    s = status.join(select(scored, policy.recency), ["entity", "attr"], "left")
    open_ = F.col("status") == "unresolved"
    commit = open_ & F.col("chosen").isNotNull() & (F.col("p") >= policy.ask)
    decision = (
        F.when(F.col("status").isin("established", "established_empty", "established_false"), "commit").when(F.col("status") == "resource_limited", "resource_limited")
        .when(~open_, "abstain").when(commit, "commit").when(F.col("p") >= policy.abstain, "ask").otherwise("abstain")
    )
    assertion = F.when(F.col("status").startswith("established"), F.col("candidates")).when(commit, F.col("chosen"))
    return s.select("entity", "attr", "status", decision.alias("decision"), assertion.alias("assertion"))
