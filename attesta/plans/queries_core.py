"""Queries over the log, admission and the kernel, each beside its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import admission as A
from attesta.operators import kernel as K
from attesta.operators.tables import cut
from attesta.plans.ctes import oracle
from attesta.plans.registry import query
from attesta.sources.report_log import report_log

#: The day asked about (2024-01-15).
DAY = -717


def evidence(spark, sf_dir, upto: int | None = None) -> DataFrame:
    return A.direct(A.evaluate(report_log(spark, sf_dir, upto)))


@query("op_t9_day_of", oracle("log", "SELECT rid, anchor, CAST(DATE '2026-01-01' + anchor AS VARCHAR) AS back FROM log"))
def day_of(spark, sf_dir):
    """OP-T9, OP-K2: anchor day of each report and its date."""
    from attesta.sources.report_log import date_of

    return report_log(spark, sf_dir).select("rid", "anchor", date_of(F.col("anchor")).cast("string").alias("back"))


@query("op_a1_source_status", oracle("pair", "SELECT source_id, source_class, status, count(*) AS reports FROM pair GROUP BY ALL"))
def source_status(spark, sf_dir):
    log = report_log(spark, sf_dir)
    return log.groupBy("source_id", "source_class", A.status_of(F.col("source_id"), F.col("source_class")).alias("status")).agg(F.count(F.lit(1)).alias("reports"))


@query("op_a2_own_merit", oracle("base", "SELECT rid, split_part(verdict, ':', 1) AS outcome, split_part(verdict, ':', 2) AS reason, effective_cue FROM base"))
def own_merit(spark, sf_dir):
    """OP-A2, OP-A3: the decision on each report by itself."""
    return A.own_merit(report_log(spark, sf_dir)).select("rid", "outcome", "reason", "effective_cue")


@query("op_a4_authority", oracle("base", """
SELECT rid, cue, allowed, CASE WHEN allowed THEN 'rule' WHEN actor LIKE 'agent:%' AND cue IN ('withdraw', 'correct') AND t_origin NOT IN ('agent_hypothesis', 'agent_statement', 'plan', 'simulation', 'counterfactual')
       THEN 'agent_invariant' ELSE 'no_matching_rule' END AS reason, ord, extent
FROM base WHERE t_lsn IS NOT NULL AND status = 'normal' AND cue IN ('correct', 'withdraw', 'dispute') AND origin <> 'attributed'"""))
def authority(spark, sf_dir):
    """OP-A4, OP-A5, OP-A6: first matching grant of each acting report, or why there is none."""
    d = A.own_merit(report_log(spark, sf_dir)).where("auth is not null")
    return d.select("rid", "cue", "auth.allowed", "auth.reason", "auth.ord", F.col("auth.targets").alias("extent"))


@query("op_a7_failed_correction", oracle("base", "SELECT rid, 'assert' AS kernel_cue, value FROM base WHERE cue = 'correct' AND effective_cue <> 'correct' AND verdict = 'admissible:admitted'"))
def failed_correction(spark, sf_dir):
    d = A.own_merit(report_log(spark, sf_dir))
    return d.where("cue = 'correct' and effective_cue <> 'correct' and outcome = 'admissible'").select("rid", F.lit("assert").alias("kernel_cue"), "value")


@query("op_a7_compat_correction", oracle("base", "SELECT rid, CASE WHEN status = 'blocked' OR t_lsn IS NOT NULL THEN 'correct' ELSE 'allege' END AS effective_cue FROM base WHERE cue = 'correct'"))
def compat_correction(spark, sf_dir):
    """OP-A7 under the compat profile: a failed correction stays a competing correction."""
    return A.own_merit(report_log(spark, sf_dir), failed_correction_allege=False).where("cue = 'correct'").select("rid", "effective_cue")


@query("op_a8_withdrawn", oracle("gone log", "SELECT l.rid, b.rid AS by_rid, g.kind FROM gone g JOIN log l ON l.lsn = g.lsn JOIN log b ON b.lsn = g.by_lsn"))
def withdrawn(spark, sf_dir):
    """OP-A8, OP-A9: withdrawn reports under live actors, explicit and source-wide."""
    from attesta.sources.report_log import rid_of

    g = A.withdrawn(A.own_merit(report_log(spark, sf_dir)))
    return g.select(rid_of(F.col("lsn")).alias("rid"), rid_of(F.col("by")).alias("by_rid"), "kind")


@query("op_a8_withdrawn_any_actor", oracle("claims", "SELECT claimed AS lsn, arg_min(by_lsn, by_lsn * 2 - explicit::INT) AS by_lsn, arg_min(kind, by_lsn * 2 - explicit::INT) AS kind FROM claims GROUP BY claimed"))
def withdrawn_any(spark, sf_dir):
    """OP-A8 where actors need not live: one pass, oldest first."""
    return A.withdrawn(A.own_merit(report_log(spark, sf_dir)), must_be_live=False).withColumnRenamed("by", "by_lsn")


@query("op_a9_source_wide", oracle("claims", "SELECT by_lsn, count(*) AS reached FROM claims WHERE NOT explicit GROUP BY by_lsn"))
def source_wide(spark, sf_dir):
    """OP-A9: how many reports each authorised source-wide withdrawal reaches."""
    base = A.own_merit(report_log(spark, sf_dir))
    size = base.groupBy("source_id").agg(F.count(F.lit(1)).alias("reached"))
    return A.wide_claims(base).join(size, "source_id").select(F.col("by").alias("by_lsn"), "reached")


@query("op_a10_confirmation", oracle("ev", "SELECT rid, reason, confirmed_by FROM ev WHERE confirmed_by IS NOT NULL"))
def confirmation(spark, sf_dir):
    """OP-A10: quarantined reports that another origin group confirms, with all that do."""
    return A.confirmations(cut(A.evaluate(report_log(spark, sf_dir)).select("rid", "reason", "outcome", "cue", "by", "entity", "attr", "sig", "grp")))


@query("op_a11_evidence_set", oracle("ev", """
SELECT entity, attr, count(*) FILTER (WHERE by_lsn IS NULL AND outcome = 'admissible' AND form <> 'belief_of' AND origin = 'external_observation') AS direct,
       count(*) FILTER (WHERE by_lsn IS NULL AND outcome = 'admissible' AND form = 'belief_of') AS attributed,
       count(*) FILTER (WHERE by_lsn IS NULL AND outcome = 'quarantined' AND cue IN ('assert', 'change', 'correct')) AS quarantined,
       count(*) FILTER (WHERE effective_cue = 'dispute' AND outcome = 'admissible' AND t_lsn IS NOT NULL) AS disputes,
       count(*) FILTER (WHERE effective_cue = 'allege' AND t_lsn IS NOT NULL) AS allegations, count(by_lsn) AS withdrawn
FROM ev GROUP BY ALL"""))
def evidence_set(spark, sf_dir):
    ev = A.evaluate(report_log(spark, sf_dir))
    live = F.col("by").isNull()
    evid = F.col("cue").isin(*A.EVIDENCE)
    t = F.col("t_lsn").isNotNull()
    ok = F.col("outcome") == "admissible"

    def many(cond, name):
        return F.count(F.when(cond, 1)).alias(name)

    return ev.groupBy("entity", "attr").agg(
        many(live & ok & evid & (F.col("form") != "belief_of") & (F.col("origin") == "external_observation"), "direct"),
        many(live & ok & evid & (F.col("form") == "belief_of"), "attributed"), many(live & (F.col("outcome") == "quarantined") & evid, "quarantined"),
        many((F.col("effective_cue") == "dispute") & ok & t, "disputes"), many((F.col("effective_cue") == "allege") & t, "allegations"), many(~live, "withdrawn"),
    )


@query("op_a12_direct_entries", oracle("direct", "SELECT entity, attr, rid, anchor, value, op, frm, grp FROM direct"))
def direct_entries(spark, sf_dir):
    """OP-A12, OP-K1: the evidence the kernel reads."""
    return evidence(spark, sf_dir).select("entity", "attr", "rid", "anchor", "value", "op", "frm", "grp")


@query("op_a13_attributions", oracle("ev", """
SELECT entity, attr, form || '|' || holder || '|' || value AS sig, count(*) AS reports, count(DISTINCT grp) AS origin_groups, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups
FROM ev WHERE outcome = 'admissible' AND by_lsn IS NULL AND form = 'belief_of' GROUP BY 1, 2, 3"""))
def attributions(spark, sf_dir):
    """OP-A13, OP-Q6: attributed claims; a group counts once."""
    ev = A.evaluate(report_log(spark, sf_dir)).where("outcome = 'admissible' and by is null and form = 'belief_of'")
    groups = F.array_sort(F.collect_set("grp"))
    return ev.groupBy("entity", "attr", "sig").agg(F.count(F.lit(1)).alias("reports"), F.size(groups).cast("long").alias("origin_groups"), F.array_join(groups, ",").alias("groups"))


_DENIAL = """
d AS (SELECT x.rid, x.entity, x.attr, x.grp, t.rid AS t_rid, t.value, t.grp AS tgrp FROM ev x JOIN direct t ON t.lsn = x.target AND t.entity = x.entity AND t.attr = x.attr
      WHERE x.effective_cue = 'dispute' AND x.outcome = 'admissible' AND x.by_lsn IS NULL)"""


@query("op_a14_dispute_denials", oracle("ev direct", "SELECT 1").replace("\nSELECT 1", "," + _DENIAL + """
SELECT rid, entity, attr, CASE WHEN attr = 'tags' THEN 'not_member' ELSE 'not_value' END AS form, value, t_rid FROM d
WHERE NOT EXISTS (SELECT 1 FROM direct c WHERE c.entity = d.entity AND c.attr = d.attr AND c.value = d.value AND c.rid <> d.t_rid AND c.grp NOT IN (d.grp, d.tgrp))"""))
def dispute_denials(spark, sf_dir):
    """OP-A14: active disputes as denials of their targets, unless a third group backs the target."""
    return A.denials(A.evaluate(report_log(spark, sf_dir)))


@query("op_a15_source_exclusion", oracle("log", """
, m AS (SELECT lsn, 's' || (lsn % 7) AS source_id, CASE WHEN lsn % 2 = 0 THEN 'exclude' ELSE 'restore' END AS op, greatest(lsn - 500, 1) AS from_lsn FROM log WHERE cue = 'assert' AND k = 95)
SELECT l.rid, max(m.lsn) AS marker_lsn FROM log l JOIN m ON m.source_id = l.source_id AND m.from_lsn <= l.lsn GROUP BY l.rid HAVING arg_max(m.op, m.lsn) = 'exclude'""").replace("\n, m AS", ",\nm AS"))
def source_exclusion(spark, sf_dir):
    """OP-A15, OP-A16: reports that the last marker in reach excludes."""
    log = report_log(spark, sf_dir)
    m = log.where("cue = 'assert' and k = 95").select(
        F.col("lsn").alias("marker_lsn"), F.concat(F.lit("s"), (F.col("lsn") % 7).cast("string")).alias("source_id"),
        F.when(F.col("lsn") % 2 == 0, "exclude").otherwise("restore").alias("op"), F.greatest(F.col("lsn") - 500, F.lit(1)).alias("from_lsn"),
    )
    return A.excluded(log, m)


@query("op_a17_compat_source_retraction", oracle("log", """
SELECT source_id, count(*) AS reports FROM log WHERE source_id IN (SELECT DISTINCT source_id FROM log WHERE cue = 'withdraw' AND k = 5) GROUP BY 1"""))
def compat_retraction(spark, sf_dir):
    """OP-A17: a marker withdraws all reports, past and future, of a source."""
    log = report_log(spark, sf_dir)
    return log.join(log.where("cue = 'withdraw' and k = 5").select("source_id").distinct(), "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("reports"))


@query("op_a19_admission_delta", oracle("ev", """
SELECT rid, 'quarantined' AS before_outcome, outcome AS after_outcome, split_part(confirmed_by, ',', 1) AS first_confirmer FROM ev WHERE reason = 'confirmed' AND split_part(confirmed_by, ',', 1) > rid"""))
def admission_delta(spark, sf_dir):
    """OP-A19: reports whose record changes after their own append, by a later first confirmer."""
    ev = A.evaluate(report_log(spark, sf_dir)).where("reason = 'confirmed'")
    return ev.where("confirmer > rid").select("rid", F.lit("quarantined").alias("before_outcome"), F.col("outcome").alias("after_outcome"), F.col("confirmer").alias("first_confirmer"))


@query("op_a20_crosscheck", oracle("ev", """
SELECT outcome, reason, count(*) AS whole, count(*) AS updated, count(*) AS equal, count(by_lsn) AS withdrawn FROM ev GROUP BY 1, 2"""))
def crosscheck(spark, sf_dir):
    """OP-A20: decisions on the whole log against those on its first nine tenths, brought up to date with the rest."""
    log = cut(report_log(spark, sf_dir))
    last = log.agg(F.max("lsn")).first()[0] or 0
    since = last - last // 10
    record = ["rid", "outcome", "reason", "effective_cue", "by", "kind", "confirmer"]
    whole = A.evaluate(log).select(*record, F.lit("whole").alias("way"))
    updated = A.update(cut(A.evaluate(log.where(F.col("lsn") <= since))), log, since).select(*record, F.lit("updated").alias("way"))
    both = whole.unionByName(updated).groupBy(*record).agg(F.count_if(F.col("way") == "whole").alias("w"), F.count_if(F.col("way") == "updated").alias("u"))
    return both.groupBy("outcome", "reason").agg(F.sum("w").alias("whole"), F.sum("u").alias("updated"), F.sum(F.least("w", "u")).alias("equal"), F.sum(F.when(F.col("by").isNotNull(), F.col("w")).otherwise(0)).alias("withdrawn"))


@query("op_a21_cross_key_corrections", oracle("log", """
, b AS (SELECT rid, cue, lsn, entity, attr, CASE WHEN k % 4 = 2 THEN lsn - 3 ELSE target END AS target FROM log)
SELECT b.rid FROM b JOIN log t ON t.lsn = b.target AND t.lsn < b.lsn WHERE b.cue = 'correct' AND (t.entity <> b.entity OR t.attr <> b.attr)""").replace("\n\n, b AS", ",\nb AS"))
def cross_key(spark, sf_dir):
    """OP-A21 over a log in which some reports are about the third before them, of whatever key."""
    log = report_log(spark, sf_dir)
    d = A.with_target(log.withColumn("target", F.when(F.col("k") % 4 == 2, F.col("lsn") - 3).otherwise(F.col("target"))))
    return d.where("cue = 'correct' and t_lsn is not null and (t_entity <> entity or t_attr <> attr)").select("rid")


@query("op_a23_admission_as_of", oracle("base", "SELECT split_part(verdict, ':', 1) AS outcome, count(*) AS n FROM base WHERE lsn <= 800 GROUP BY 1"))
def admission_as_of(spark, sf_dir):
    """OP-A23: own-merit decisions of a prefix; each reads only rows before it."""
    return A.own_merit(report_log(spark, sf_dir, 800)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("op_k3_interpretations", oracle("interp", "SELECT entity, attr, count(*) AS interpretations, sum(mask)::BIGINT AS mask_sum FROM interp GROUP BY 1, 2"))
def interpretations(spark, sf_dir):
    """OP-K3, OP-K4, OP-K5: how many labellings of each key are admissible."""
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited")
    return k.select("entity", "attr", F.size("masks").cast("long").alias("interpretations"), F.expr("aggregate(masks, 0L, (a, b) -> a + b)").alias("mask_sum"))


@query("op_k6_relaxation", oracle("lev", "SELECT entity, attr, level FROM lev"))
def relaxation(spark, sf_dir):
    return K.interpretations(evidence(spark, sf_dir)).where("not limited").select("entity", "attr", "level")


@query("op_k7_runs", oracle("runs", "SELECT entity, attr, mask, value, CAST(first AS INT) AS first, CAST(last AS INT) AS last, array_to_string(ids, ',') AS members FROM runs"))
def runs(spark, sf_dir):
    """OP-K7, OP-K8, OP-P1: maximal runs of every admissible labelling and their members."""
    k = K._runs(K.interpretations(evidence(spark, sf_dir)).where("not limited"))
    one = k.select("entity", "attr", "reps", F.explode_outer("runs").alias("y"))
    run = one.select("entity", "attr", "reps", F.col("y.x").alias("mask"), F.explode_outer(F.expr("array_distinct(filter(y.r, r -> r <> 0))")).alias("e")).where("e is not null")
    inside = "filter(transform(reps, (p, j) -> named_struct('p', p, 'in', (e & shiftleft(1L, j)) <> 0)), q -> q.in)"
    run = run.withColumn("q", F.expr(inside))
    return run.select(
        "entity", "attr", "mask", F.expr("q[0].p.value").alias("value"), F.expr("array_min(transform(q, z -> z.p.anchor))").alias("first"), F.expr("array_max(transform(q, z -> z.p.anchor))").alias("last"), F.expr(K.ID_LIST).alias("members")
    )


@query("op_k10_breakpoints", oracle("days", "SELECT entity, attr, CAST(d AS INT) AS day FROM days"))
def breakpoints(spark, sf_dir):
    return K.pieces(K.interpretations(evidence(spark, sf_dir))).where("lo is not null").select("entity", "attr", F.col("lo").alias("day"))


_AT = """
, here AS (SELECT s.entity, s.attr, s.status, s.candidates FROM seg0 s WHERE (s.lo IS NULL OR s.lo <= -717) AND (s.hi IS NULL OR s.hi > -717))
SELECT k.entity, k.attr, CAST(k.n AS INT) AS n, coalesce(here.status, 'resource_limited') AS status, here.candidates FROM keyn k LEFT JOIN here USING (entity, attr)"""


@query("op_k13_status_at_day", oracle("seg0 keyn", _AT).replace("\n\n, here AS", ",\nhere AS"))
def status_at_day(spark, sf_dir):
    """OP-K9, OP-K11, OP-K12, OP-K13: status and candidates of every key on one day. The flagship query."""
    return K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY)


@query("op_k12_family_at_day", oracle("fam", "SELECT entity, attr, CASE WHEN world = '' THEN '(empty)' ELSE world END AS world FROM fam WHERE (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)"))
def family_at_day(spark, sf_dir):
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited")
    return k.select("entity", "attr", F.explode_outer(F.expr(K.family(str(DAY)))).alias("world")).withColumn("world", F.when(F.col("world") == "", "(empty)").otherwise(F.col("world")))


@query("op_k14_segments", oracle("segment", "SELECT * FROM segment"))
def segments(spark, sf_dir):
    """OP-K14, OP-P6: maximal segments of valid time with status, candidates and supports."""
    return K.segments(K.interpretations(evidence(spark, sf_dir)))


@query("op_k15_segment_lookup", oracle("segment", "SELECT entity, attr, lo, hi, status, candidates FROM segment WHERE (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)"))
def segment_lookup(spark, sf_dir):
    s = K.segments(K.interpretations(evidence(spark, sf_dir)))
    return s.where(f"(lo is null or lo <= {DAY}) and (hi is null or hi > {DAY})").select("entity", "attr", "lo", "hi", "status", "candidates")


@query("op_k15_last_segment", oracle("segment", "SELECT entity, attr, lo, status, candidates FROM segment WHERE hi IS NULL"))
def last_segment(spark, sf_dir):
    """OP-K15 without a day: the last segment."""
    s = K.segments(K.interpretations(evidence(spark, sf_dir)))
    best = F.max_by(F.struct("lo", "status", "candidates"), F.coalesce("lo", F.lit(-(10**9)))).alias("b")
    return s.groupBy("entity", "attr").agg(best).select("entity", "attr", "b.lo", "b.status", "b.candidates")


@query("op_k16_holds", oracle("worlds", """
SELECT entity, attr, bool_and(list_contains(string_split(world, '+'), 'v1')) AS all_true, bool_or(list_contains(string_split(world, '+'), 'v1')) AS any_true
FROM (SELECT DISTINCT entity, attr, world FROM worlds WHERE (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)) GROUP BY 1, 2"""))
def holds(spark, sf_dir):
    """OP-K16: whether v1 holds in every or any world of the day."""
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited").withColumn("fam", F.expr(K.family(str(DAY))))
    has = "array_contains(split(w, '[+]'), 'v1')"
    return k.select("entity", "attr", F.expr(f"forall(fam, w -> {has})").alias("all_true"), F.expr(f"exists(fam, w -> {has})").alias("any_true"))


@query("op_k17_changed", oracle("runs interp", """
SELECT i.entity, i.attr, bool_and(c) AS all_true, bool_or(c) AS any_true FROM (
  SELECT i.entity, i.attr, i.mask, EXISTS (SELECT 1 FROM runs a JOIN runs b ON b.entity = a.entity AND b.attr = a.attr AND b.mask = a.mask
    WHERE a.entity = i.entity AND a.attr = i.attr AND a.mask = i.mask AND a.value = 'v0' AND b.value = 'v1' AND a.end_hi < 1000000 AND b.first >= a.end_hi) AS c
  FROM interp i WHERE i.attr <> 'tags') i GROUP BY 1, 2"""))
def changed(spark, sf_dir):
    """OP-K17: whether a run of v0 ended and one of v1 came later, per labelling of single-valued keys."""
    k = K._runs(K.interpretations(evidence(spark, sf_dir)).where("not limited and single"))
    # a run of v0 ends where a TRUE rival follows it; a later TRUE report of v1 starts or continues a run after that
    c = """transform(runs, y -> exists(sequence(0, n - 1), i -> reps[i].value = 'v0' and y.r[i] <> 0 and
        exists(sequence(0, n - 1), j -> j > i and reps[j].value = 'v1' and y.r[j] <> 0)))"""
    k = k.withColumn("c", F.expr(c))
    return k.select("entity", "attr", F.expr("forall(c, x -> x)").alias("all_true"), F.expr("exists(c, x -> x)").alias("any_true"))


@query("op_k18_erroneous", oracle("interp lab", """
SELECT l.rid, bool_and(NOT l.t) AS all_err, bool_or(NOT l.t) AS any_err FROM lab l JOIN interp USING (entity, attr, mask) GROUP BY 1"""))
def erroneous(spark, sf_dir):
    """OP-K18, OP-K27: reports that are ERR in every or some labelling."""
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited")
    bits = k.withColumns({"any_t": F.expr("aggregate(masks, 0L, (a, b) -> a | b)"), "all_t": F.expr("aggregate(masks, -1L, (a, b) -> a & b)")})
    one = bits.select(F.posexplode("reps").alias("i", "r"), "any_t", "all_t")
    b = F.expr("shiftleft(1L, i)")
    return one.select("r.rid", (F.col("any_t").bitwiseAND(b) == 0).alias("all_err"), (F.col("all_t").bitwiseAND(b) == 0).alias("any_err"))


@query("op_k19_budget", oracle("keyn", "SELECT entity, attr, CAST(n AS INT) AS n, n > 7 AS resource_limited FROM keyn"))
def budget(spark, sf_dir):
    """OP-K19 with a budget of 7: larger keys are resource-limited, never degraded."""
    k = K.interpretations(evidence(spark, sf_dir), budget=7)
    return k.select("entity", "attr", "n", F.col("masks").isNull().alias("resource_limited"))


@query("op_k25_dispatch", oracle("obs", """
SELECT entity, attr, CASE WHEN any_value(single) AND any_value(changeable) THEN 'fast' WHEN count(*) <= 12 THEN 'enumeration' ELSE 'resource_limited' END AS route, count(*) AS n FROM obs GROUP BY 1, 2"""))
def dispatch(spark, sf_dir):
    k = K._flags(K.keys(evidence(spark, sf_dir)))
    route = F.when(F.col("single") & F.col("changeable"), "fast").when(F.col("n") <= K.BUDGET, "enumeration").otherwise("resource_limited")
    return k.select("entity", "attr", route.alias("route"), F.col("n").cast("long").alias("n"))


@query("op_k26_branch_bound", oracle("direct", """
SELECT entity, attr, CAST((1::BIGINT << CAST(any_value(c) AS INT)) * product(nv) AS BIGINT) AS bound FROM (
  SELECT entity, attr, anchor, count(DISTINCT value) AS nv, (SELECT count(*) FROM direct x WHERE x.entity = d.entity AND x.attr = d.attr AND x.op = 'correction') AS c FROM direct d GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def branch_bound(spark, sf_dir):
    """OP-K26: two to the number of corrections times the distinct values at tied anchors."""
    d = evidence(spark, sf_dir)
    at = d.groupBy("entity", "attr", "anchor").agg(F.count_distinct("value").alias("nv"), F.count(F.when(F.col("op") == "correction", 1)).alias("c"))
    return at.groupBy("entity", "attr").agg((F.expr("shiftleft(1L, cast(sum(c) as int))") * F.round(F.product("nv")).cast("long")).alias("bound"))


_P3 = oracle("minenv", "SELECT entity, attr, CAST(lo AS INT) AS lo, CASE WHEN world = '' THEN '(empty)' ELSE world END AS world, len(env)::INT AS size, array_to_string(env, ',') AS env FROM minenv")


@query("op_p3_minimal_environments", _P3)
def minimal_environments(spark, sf_dir):
    """OP-P2, OP-P3: the subset-minimal environments of each candidate in each piece of valid time."""
    p = K.supports(K.pieces(K.interpretations(evidence(spark, sf_dir))))
    w = p.select("entity", "attr", "lo", F.explode_outer("sup").alias("s")).select("entity", "attr", "lo", F.col("s.world").alias("world"), F.explode_outer("s.envs").alias("env"))
    size = F.when(F.col("env") == "", 0).otherwise(F.size(F.split("env", ",")))
    return w.select("entity", "attr", "lo", F.when(F.col("world") == "", "(empty)").otherwise(F.col("world")).alias("world"), size.alias("size"), "env")


@query("op_p7_explain_one", oracle("minenv", """
SELECT entity, attr, world, min(array_to_string(env, ',')) AS env FROM minenv WHERE world <> '' AND (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717) GROUP BY 1, 2, 3"""))
def explain_one(spark, sf_dir):
    """OP-P7: the lexicographically least environment of each candidate of the day."""
    p = K.pieces(K.interpretations(evidence(spark, sf_dir))).where(f"(lo is null or lo <= {DAY}) and (hi is null or hi > {DAY})")
    s = K.supports(p).select("entity", "attr", F.explode_outer("sup").alias("s")).where("s.world <> ''")
    return s.select("entity", "attr", F.col("s.world").alias("world"), F.array_min("s.envs").alias("env"))


@query("op_p8_flat_provenance", oracle("fam direct", """
SELECT d.entity, d.attr, string_agg(d.rid, ',' ORDER BY d.rid) AS ids FROM direct d
WHERE EXISTS (SELECT 1 FROM fam f WHERE f.entity = d.entity AND f.attr = d.attr AND (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717) AND list_contains(string_split(f.world, '+'), d.value)) GROUP BY 1, 2"""))
def flat_provenance(spark, sf_dir):
    """OP-P8, OP-C4: reports whose value is in any candidate world of the day."""
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited").withColumn("fam", F.expr(K.family(str(DAY))))
    ids = F.expr("array_join(array_sort(transform(filter(reps, p -> exists(fam, w -> array_contains(split(w, '[+]'), p.value))), p -> p.rid)), ',')")
    return cut(k.select("entity", "attr", ids.alias("ids"))).where("ids <> ''")  # else the predicate repeats the expression


@query("op_p10_flatten", oracle("minenv", """
SELECT entity, attr, CAST(lo AS INT) AS lo, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT entity, attr, lo, unnest(env) AS id FROM minenv) GROUP BY 1, 2, 3"""))
def flatten_envs(spark, sf_dir):
    p = K.supports(K.pieces(K.interpretations(evidence(spark, sf_dir))))
    ids = F.expr("array_join(array_sort(array_distinct(filter(flatten(flatten(transform(sup, s -> transform(s.envs, e -> split(e, ','))))), x -> x <> ''))), ',')")
    return cut(p.select("entity", "attr", "lo", ids.alias("ids"))).where("ids <> ''")


@query("op_p11_explanation_cut", oracle("minenv", """
SELECT entity, attr, world, env FROM (
  SELECT entity, attr, world, array_to_string(env, ',') AS env, row_number() OVER (PARTITION BY entity, attr ORDER BY world, len(env), array_to_string(env, ',')) AS n
  FROM minenv WHERE world <> '' AND (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)) WHERE n <= 2"""))
def explanation_cut(spark, sf_dir):
    """OP-P11: the first two supports of each key's answer."""
    p = K.pieces(K.interpretations(evidence(spark, sf_dir))).where(f"(lo is null or lo <= {DAY}) and (hi is null or hi > {DAY})")
    all_ = F.expr("slice(flatten(transform(filter(sup, s -> s.world <> ''), s -> transform(s.envs, e -> named_struct('world', s.world, 'env', e)))), 1, 2)")
    return K.supports(p).select("entity", "attr", F.explode_outer(all_).alias("s")).where("s is not null").select("entity", "attr", "s.world", "s.env")


@query("op_p12_attribution_support", oracle("ev", """
SELECT entity, attr, form || '|' || holder || '|' || value AS sig, grp, arg_min(rid, lsn) AS rid FROM ev WHERE outcome = 'admissible' AND by_lsn IS NULL AND form = 'belief_of' GROUP BY 1, 2, 3, 4"""))
def attribution_support(spark, sf_dir):
    ev = A.evaluate(report_log(spark, sf_dir)).where("outcome = 'admissible' and by is null and form = 'belief_of'")
    return ev.groupBy("entity", "attr", "sig", "grp").agg(F.min_by("rid", "lsn").alias("rid"))
