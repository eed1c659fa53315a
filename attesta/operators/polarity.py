"""Keys whose evidence holds denials: closed-form status from grouped aggregates, and the scope in which it is defined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(evidence: DataFrame) -> DataFrame:
    """Per key the sets of affirmed and denied values and what the scope test asks. ``evidence`` has entity, attr, form, value, cue, valid_from."""
    pos = F.col("form").isin("value", "member")
    return evidence.groupBy("entity", "attr").agg(
        F.array_sort(F.collect_set(F.when(pos, F.col("value")))).alias("pos"), F.array_sort(F.collect_set(F.when(~pos, F.col("value")))).alias("neg"),
        F.bool_or(F.col("form").isin("value", "not_value")).alias("single"), F.bool_or(F.col("form").isin("member", "not_member")).alias("multi"),
        F.bool_or(F.col("cue") != "assert").alias("other_cue"), F.bool_or(F.col("valid_from").isNotNull()).alias("valid_time"),
    )


def scope_problem():
    both = F.size(F.array_intersect("pos", "neg"))
    return (
        F.when(F.col("other_cue"), "cue").when(F.col("valid_time"), "valid_time").when(F.col("single") & F.col("multi"), "mixed")
        .when(F.col("single") & (F.size("pos") > 1), "competing").when(F.col("multi") & (both > 1), "contested")
    )


def status(evidence: DataFrame) -> DataFrame:
    """entity, attr, problem, status, candidates: five outcomes for keys in scope, null status outside it."""
    g = grouped(evidence).withColumn("problem", scope_problem())
    d = F.array_intersect("pos", "neg")
    base = F.array_except("pos", "neg")
    none, hit = F.size("pos") == 0, F.size(d) > 0
    one_denial = F.size("neg") == 1

    def text(prefix, arr):
        return F.array_join(F.transform(arr, lambda v: F.concat(F.lit(prefix), v)), "|")

    kind = F.when(F.col("single"), "not_value:").otherwise("not_member:")
    stat = F.when(none & one_denial, "established_false").when(none, "unknown").when(hit, "unresolved").otherwise("established")
    sets = F.concat(F.lit("set:"), F.array_join("pos", "+"))
    with_d = F.concat(F.lit("set:"), F.array_join(F.col("pos"), "+"))
    without = F.when(F.size(base) > 0, F.concat(F.lit("set:"), F.array_join(base, "+"))).otherwise(F.concat(F.lit("not_member:"), d[0]))
    cand = (
        F.when(none, F.array_join(F.transform("neg", lambda v: F.concat(kind, v)), "|"))
        .when(F.col("single") & hit, F.concat(F.lit("value:"), F.col("pos")[0], F.lit("|not_value:"), d[0])).when(F.col("single"), F.concat(F.lit("value:"), F.col("pos")[0]))
        .when(hit, F.concat_ws("|", with_d, without)).otherwise(sets)
    )
    ok = F.col("problem").isNull()
    return g.select("entity", "attr", "problem", F.when(ok, stat).alias("status"), F.when(ok, cand).alias("candidates"))
