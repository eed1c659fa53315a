"""Queries over policy, answers, polarity, baselines and the compat projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.operators import admission as A
from attesta.operators import kernel as K
from attesta.operators import policy as P
from attesta.operators import polarity as N
from attesta.operators.tables import apart, cut
from attesta.plans.ctes import cte, oracle
from attesta.plans.queries_core import DAY, evidence
from attesta.plans.registry import query
from attesta.sources.report_log import EVIDENCE, report_log, table

_HERE = "(lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)"
cte("mday", "minenv", f"SELECT entity, attr, CASE WHEN world = '' THEN '(empty)' ELSE world END AS cand, env FROM minenv WHERE {_HERE}")
cte("sday", "mday direct", """
SELECT s.entity, s.attr, s.cand, s.rid, d.lsn, d.grp, d.source_class, CASE d.source_class WHEN 'trusted' THEN 2.2::DOUBLE WHEN 'standard' THEN 1.2::DOUBLE WHEN 'low' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS prior
FROM (SELECT DISTINCT entity, attr, cand, unnest(env) AS rid FROM mday) s JOIN direct d ON d.rid = s.rid""")
cte("gw", "sday", "SELECT entity, attr, cand, grp, max(prior) AS weight FROM sday GROUP BY ALL")
cte("pro", "mday gw sday", """
SELECT c.entity, c.attr, c.cand, round(coalesce((SELECT sum(weight) FROM gw WHERE gw.entity = c.entity AND gw.attr = c.attr AND gw.cand = c.cand), 0), 6) AS pro,
       coalesce((SELECT max(lsn) FROM sday s WHERE s.entity = c.entity AND s.attr = c.attr AND s.cand = c.cand), -1) AS newest,
       (SELECT count(DISTINCT grp) FROM sday s WHERE s.entity = c.entity AND s.attr = c.attr AND s.cand = c.cand) AS groups
FROM (SELECT DISTINCT entity, attr, cand FROM mday) c""")
cte("con", "pro", "SELECT *, round(sum(pro) OVER (PARTITION BY entity, attr) - pro, 6) AS con FROM pro")
cte("scored", "con", "SELECT entity, attr, cand, round(least(1 / (1 + exp(-(pro - con + CASE WHEN con = 0 THEN 0.5 ELSE 0 END))), 1 - 1e-9), 9) AS score, newest, groups FROM con")
cte("chosen", "scored", """
SELECT entity, attr, arg_min(cand, (-score, cand)) AS conf, max(score) AS conf_p, count(*) FILTER (WHERE score = top) > 1 AS conf_tie,
       arg_min(cand, (-newest, cand)) AS rec, arg_min(score, (-newest, cand)) AS rec_p, count(*) FILTER (WHERE newest = new_top) > 1 AS rec_tie
FROM (SELECT *, max(score) OVER w AS top, max(newest) OVER w AS new_top FROM scored WINDOW w AS (PARTITION BY entity, attr)) GROUP BY 1, 2""")
cte("sthere", "seg0 keyn", f"SELECT k.entity, k.attr, coalesce(s.status, 'resource_limited') AS status, s.candidates FROM keyn k LEFT JOIN (SELECT * FROM seg0 WHERE {_HERE}) s USING (entity, attr)")


def here(spark, sf_dir):
    """(interpretations, the piece of each key that holds the day with its supports)."""
    inter = cut(K.interpretations(evidence(spark, sf_dir)))  # one row per key, read by status and supports alike
    return inter, K.supports(K.pieces(inter).where(f"(lo is null or lo <= {DAY}) and (hi is null or hi > {DAY})"))


def supported(spark, sf_dir, only: str = "true"):
    """The pieces of ``here`` alone, of the keys that ``only`` holds for: what the kernel makes stays in its partitions, each with its keys."""
    inter = K.interpretations(evidence(spark, sf_dir).where(only))
    return K.supports(K.pieces(inter).where(f"(lo is null or lo <= {DAY}) and (hi is null or hi > {DAY})"))


@query("op_y1_group_weights", oracle("gw", "SELECT * FROM gw"))
def group_weights(spark, sf_dir):
    return P.group_weights(P.supporting(supported(spark, sf_dir)))


@query("op_y2_score", oracle("scored", "SELECT entity, attr, cand, score FROM scored"))
def score(spark, sf_dir):
    return P.scores(P.supporting(supported(spark, sf_dir))).select("entity", "attr", "cand", "score")


@query("op_y3_newest", oracle("scored", "SELECT entity, attr, cand, newest FROM scored"))
def newest(spark, sf_dir):
    return P.scores(P.supporting(supported(spark, sf_dir))).select("entity", "attr", "cand", "newest")


@query("op_y4_select", oracle("chosen", """
SELECT entity, attr, CASE WHEN NOT conf_tie THEN conf END AS by_confidence, CASE WHEN NOT rec_tie THEN rec END AS by_recency FROM chosen"""))
def select(spark, sf_dir):
    s = cut(P.scores(P.supporting(supported(spark, sf_dir))))
    a = P.select(s, False).select("entity", "attr", F.col("chosen").alias("by_confidence"))
    return a.join(apart(P.select(s, True).select("entity", "attr", F.col("chosen").alias("by_recency"))), ["entity", "attr"])


def _decide_sql(p: P.Policy) -> str:
    pick, val = ("rec", "rec_p") if p.recency else ("conf", "conf_p")
    if p.recency:
        val = "CASE WHEN rec_tie THEN conf_p ELSE rec_p END"
    commit = f"status = 'unresolved' AND NOT {pick}_tie AND {val} >= {p.ask}"
    return f"""SELECT '{p.name}' AS policy, s.entity, s.attr, s.status,
  CASE WHEN status LIKE 'established%' THEN 'commit' WHEN status = 'resource_limited' THEN status WHEN status <> 'unresolved' THEN 'abstain' WHEN {commit} THEN 'commit' WHEN {val} >= {p.abstain} THEN 'ask' ELSE 'abstain' END AS decision,
  CASE WHEN status LIKE 'established%' THEN candidates WHEN {commit} THEN {pick} END AS assertion FROM sthere s LEFT JOIN chosen c USING (entity, attr)"""


@query("op_y5_decide", oracle("sthere chosen", "\nUNION ALL\n".join(_decide_sql(p) for p in P.PRESETS)))
def decide(spark, sf_dir):
    """OP-Y5, OP-Y6, OP-Q1: the answer of each key under the four presets."""
    inter, piece = here(spark, sf_dir)
    status, s = cut(K.status_at(inter, DAY)), cut(P.scores(P.supporting(piece)))
    out = None
    for p in P.PRESETS:
        one = P.decide(status, s, p).select(F.lit(p.name).alias("policy"), "entity", "attr", "status", "decision", "assertion")
        out = one if out is None else out.unionByName(one)
    return out


@query("op_y7_single_origin", oracle("scored", "SELECT entity, attr, cand, groups <= 1 AS single_origin FROM scored WHERE cand <> '(empty)'"))
def single_origin(spark, sf_dir):
    return P.scores(P.supporting(supported(spark, sf_dir))).where("cand <> '(empty)'").select("entity", "attr", "cand", (F.col("groups") <= 1).alias("single_origin"))


@query("op_y8_resolvers", oracle("sday sthere", """
, known(c, w) AS (VALUES ('trusted', 2.2), ('standard', 1.2), ('low', 0.3))
SELECT s.entity, s.attr, string_agg(k.c, ',' ORDER BY k.w DESC, k.c) AS resolvers
FROM sthere s LEFT JOIN (SELECT entity, attr, max(prior) AS best FROM sday GROUP BY 1, 2) h USING (entity, attr) CROSS JOIN known k
WHERE s.status = 'unresolved' AND (h.best IS NULL OR k.w >= h.best) GROUP BY 1, 2""").replace("\n\n, known", ",\nknown"))
def resolvers(spark, sf_dir):
    """OP-Y8: source classes at least as trusted as the best heard on an unresolved key."""
    inter, piece = here(spark, sf_dir)
    best = P.supporting(piece).where("rid is not null").groupBy("entity", "attr").agg(F.max(P.prior_of(F.col("source_class"))).alias("best"))
    s = K.status_at(inter, DAY).where("status = 'unresolved'").join(best, ["entity", "attr"], "left")
    known = F.array(*[F.struct(F.lit(-w).alias("neg"), F.lit(c).alias("c")) for c, w in P.PRIORS.items()])
    pool = F.filter(F.array_sort(known), lambda k: F.col("best").isNull() | (-k["neg"] >= F.col("best")))
    return s.select("entity", "attr", F.array_join(F.transform(pool, lambda k: k["c"]), ",").alias("resolvers"))


@query("op_y9_reprojection", oracle("sthere", "SELECT entity, attr, CASE WHEN status = 'unknown' AND attr = 'tags' THEN 'established_empty' ELSE status END AS status FROM sthere"))
def reprojection(spark, sf_dir):
    """OP-Y9: the same families under the compat profile."""
    return K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY, compat=True).select("entity", "attr", "status")


@query("op_q9_diff", oracle("sthere", "SELECT entity, attr, status, candidates FROM sthere").replace("FROM events", "FROM events WHERE event_id < 700"))
def as_of_answer(spark, sf_dir):
    """OP-Q1, OP-Q2, OP-Q7: answers for the day as believed at log position 700."""
    return K.status_at(K.interpretations(evidence(spark, sf_dir, 700)), DAY).select("entity", "attr", "status", "candidates")


@query("op_q10_inspect", oracle("log", "SELECT origin, cue, count(*) AS reports FROM log GROUP BY 1, 2"))
def inspect(spark, sf_dir):
    return report_log(spark, sf_dir).groupBy("origin", "cue").agg(F.count(F.lit(1)).alias("reports"))


@query("op_q10_status_counts", oracle("sthere", "SELECT attr, status, count(*) AS keys FROM sthere GROUP BY 1, 2"))
def status_counts(spark, sf_dir):
    return K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY).groupBy("attr", "status").agg(F.count(F.lit(1)).alias("keys"))


@query("op_q11_reports", oracle("ev", "SELECT rid, entity, attr, cue, effective_cue, outcome, reason, by_lsn IS NOT NULL AS withdrawn FROM ev WHERE cue = 'correct' AND origin = 'external_observation'"))
def reports(spark, sf_dir):
    ev = A.evaluate(report_log(spark, sf_dir)).where("cue = 'correct' and origin = 'external_observation'")
    return ev.select("rid", "entity", "attr", "cue", "effective_cue", "outcome", "reason", F.col("by").isNotNull().alias("withdrawn"))


@query("op_q12_find", oracle("log", """
, e AS (SELECT DISTINCT entity FROM log), a(attr) AS (VALUES ('employer'), ('birthplace'), ('tags')),
h AS (SELECT entity, attr, 2 * len(list_intersect(['u1', '2'], string_split(entity, '-'))) + (attr = 'employer')::INT AS hit FROM e, a WHERE attr = 'employer')
SELECT entity, attr, CAST(hit AS INT) AS hit FROM h WHERE hit > 0 ORDER BY hit DESC, entity, attr LIMIT 20""").replace("\n\n, e AS", ",\ne AS"))
def find(spark, sf_dir):
    """OP-Q12: keys for the text 'u1 2 employer' by token overlap; the top 20."""
    want = ["u1", "2", "employer"]
    tokens = F.array(*[F.lit(t) for t in want])
    attrs = [a for a in K.SPECS if a in want] or list(K.SPECS)
    e = report_log(spark, sf_dir).select("entity").distinct().withColumn("attr", F.explode(F.array(*[F.lit(a) for a in attrs])))
    hit = 2 * F.size(F.array_intersect(tokens, F.split("entity", "-"))) + F.col("attr").isin(*want).cast("int")
    return e.select("entity", "attr", hit.alias("hit")).where("hit > 0").orderBy(F.desc("hit"), "entity", "attr").limit(20)


@query("op_q13_source_class", oracle("log", "SELECT source_id, arg_max(source_class, lsn) AS class, CASE arg_max(source_class, lsn) WHEN 'quarantined' THEN 'quarantined' WHEN 'blocked' THEN 'blocked' ELSE 'normal' END AS status FROM log GROUP BY 1"))
def source_class(spark, sf_dir):
    s = report_log(spark, sf_dir).groupBy("source_id").agg(F.max_by("source_class", "lsn").alias("class"))
    return s.withColumn("status", A.status_of(F.col("source_id"), F.col("class")))


@query("op_q14_target_hint", oracle("log", "SELECT entity, value, max(rid) AS rid FROM log WHERE cue IN ('assert', 'change', 'correct') GROUP BY 1, 2"))
def target_hint(spark, sf_dir):
    """OP-Q14: the newest report that a hint of entity and value names."""
    return report_log(spark, sf_dir).where(F.col("cue").isin(*EVIDENCE)).groupBy("entity", "value").agg(F.max_by("rid", "lsn").alias("rid"))


cte("pol", "log", """
SELECT entity, attr, CASE WHEN k % 5 = 0 THEN CASE attr WHEN 'tags' THEN 'not_member' ELSE 'not_value' END ELSE CASE attr WHEN 'tags' THEN 'member' ELSE 'value' END END AS form, value, cue, valid_from
FROM log WHERE cue IN ('assert', 'change') AND origin = 'external_observation' AND (k % 10 >= 6 OR k % 5 < 2)""")
cte("polk", "pol", """
SELECT entity, attr, coalesce(list_sort(list(DISTINCT value) FILTER (WHERE form IN ('value', 'member'))), []) AS pos, coalesce(list_sort(list(DISTINCT value) FILTER (WHERE form IN ('not_value', 'not_member'))), []) AS neg,
       bool_or(cue <> 'assert') AS oc, bool_or(valid_from IS NOT NULL) AS vt FROM pol GROUP BY 1, 2""")
cte("polp", "polk", """
SELECT *, list_sort(list_intersect(pos, neg)) AS d, list_sort(list_filter(pos, lambda v: NOT list_contains(neg, v))) AS b,
       CASE WHEN oc THEN 'cue' WHEN vt THEN 'valid_time' WHEN attr <> 'tags' AND len(pos) > 1 THEN 'competing' WHEN attr = 'tags' AND len(list_intersect(pos, neg)) > 1 THEN 'contested' END AS problem FROM polk""")


def polar(spark, sf_dir):
    log = report_log(spark, sf_dir).where("cue in ('assert', 'change') and origin = 'external_observation' and (k % 10 >= 6 or k % 5 < 2)")
    deny = F.col("k") % 5 == 0
    form = F.when(F.col("attr") == "tags", F.when(deny, "not_member").otherwise("member")).otherwise(F.when(deny, "not_value").otherwise("value"))
    return log.select("entity", "attr", form.alias("form"), "value", "cue", "valid_from")


@query("op_k20_polarity", oracle("polp", """
SELECT entity, attr, CASE WHEN len(pos) = 0 AND len(neg) = 1 THEN 'established_false' WHEN len(pos) = 0 THEN 'unknown' WHEN len(d) > 0 THEN 'unresolved' ELSE 'established' END AS status,
  CASE WHEN len(pos) = 0 THEN array_to_string(list_transform(neg, lambda v: CASE attr WHEN 'tags' THEN 'not_member:' ELSE 'not_value:' END || v), '|')
       WHEN attr <> 'tags' THEN 'value:' || pos[1] || CASE WHEN len(d) > 0 THEN '|not_value:' || d[1] ELSE '' END
       ELSE 'set:' || array_to_string(pos, '+') || CASE WHEN len(d) = 0 THEN '' WHEN len(b) > 0 THEN '|set:' || array_to_string(b, '+') ELSE '|not_member:' || d[1] END END AS candidates
FROM polp WHERE problem IS NULL"""))
def polarity(spark, sf_dir):
    return N.status(polar(spark, sf_dir)).where("problem is null").select("entity", "attr", "status", "candidates")


@query("op_k21_polarity_scope", oracle("polp", "SELECT problem, count(*) AS keys FROM polp WHERE problem IS NOT NULL GROUP BY 1"))
def polarity_scope(spark, sf_dir):
    return N.status(polar(spark, sf_dir)).where("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("keys"))


@query("op_c1_answer_v1", oracle("sthere", """
SELECT entity, attr, CASE WHEN status LIKE 'established%' THEN 'established' ELSE status END AS status, CASE WHEN status = 'established' THEN candidates END AS assertion, CASE WHEN status = 'unresolved' THEN candidates END AS alternatives
FROM sthere WHERE status <> 'resource_limited'"""))
def answer_v1(spark, sf_dir):
    s = K.status_at(K.interpretations(evidence(spark, sf_dir)).where("not limited"), DAY)  # a predicate on status would run the kernel twice
    est = F.col("status").startswith("established")
    return s.select("entity", "attr", F.when(est, "established").otherwise(F.col("status")).alias("status"), F.when(est, F.col("candidates")).alias("assertion"), F.when(F.col("status") == "unresolved", F.col("candidates")).alias("alternatives"))


@query("op_c2_yesno", oracle("worlds", """
SELECT entity, attr, CASE WHEN bool_and(h) OR NOT bool_or(h) THEN 'established' ELSE 'possible' END AS status, CASE WHEN bool_or(h) THEN true ELSE false END AS assertion
FROM (SELECT DISTINCT entity, attr, world, list_contains(string_split(world, '+'), 'v1') AS h FROM worlds WHERE (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)) GROUP BY 1, 2"""))
def yesno(spark, sf_dir):
    k = K.interpretations(evidence(spark, sf_dir)).where("not limited").withColumn("fam", F.expr(K.family(str(DAY))))
    has = "array_contains(split(w, '[+]'), 'v1')"
    all_, any_ = F.expr(f"forall(fam, w -> {has})"), F.expr(f"exists(fam, w -> {has})")
    return k.select("entity", "attr", F.when(all_ | ~any_, "established").otherwise("possible").alias("status"), any_.alias("assertion"))


@query("op_c3_reported", oracle("direct", "SELECT entity, attr, value, string_agg(rid, ',' ORDER BY rid) AS ids FROM direct GROUP BY 1, 2, 3"))
def reported(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("entity", "attr", "value").agg(F.array_join(F.array_sort(F.collect_list("rid")), ",").alias("ids"))


@query("op_b1_last_write_wins", oracle("log", "SELECT entity, attr, arg_max(value, lsn) AS value FROM log WHERE value IS NOT NULL AND lsn <= 900 GROUP BY 1, 2"))
def lww(spark, sf_dir):
    return report_log(spark, sf_dir, 900).where("value is not null").groupBy("entity", "attr").agg(F.max_by("value", "lsn").alias("value"))


@query("op_b2_lww_retract", oracle("log", "SELECT entity, attr, arg_max(value, lsn) AS value FROM log l WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log w WHERE w.cue IN ('withdraw', 'correct') AND w.target = l.lsn) GROUP BY 1, 2"))
def lww_retract(spark, sf_dir):
    log = report_log(spark, sf_dir)
    gone = log.where("cue in ('withdraw', 'correct')").select(F.col("target").alias("lsn"))
    return log.where("value is not null").join(gone, "lsn", "left_anti").groupBy("entity", "attr").agg(F.max_by("value", "lsn").alias("value"))


@query("op_b3_stale_plan", oracle("log", """
SELECT entity, attr, arg_max(value, lsn) FILTER (WHERE lsn <= 500) AS stale, arg_max(value, lsn) AS fresh FROM log WHERE value IS NOT NULL AND lsn <= 900 GROUP BY 1, 2 HAVING stale IS NOT NULL AND stale <> fresh"""))
def stale_plan(spark, sf_dir):
    """OP-B3: plans made at position 500 that position 900 contradicts."""
    log = report_log(spark, sf_dir, 900).where("value is not null")
    b = log.groupBy("entity", "attr").agg(F.max_by("value", F.when(F.col("lsn") <= 500, F.col("lsn"))).alias("stale"), F.max(F.when(F.col("lsn") <= 500, 1)).alias("has"), F.max_by("value", "lsn").alias("fresh"))
    return b.where("has = 1 and stale <> fresh").select("entity", "attr", "stale", "fresh")


_CHOSEN = "CASE WHEN doc_id % 7 = 0 THEN 'ask' WHEN doc_id % 11 = 0 THEN 'abstain' WHEN doc_id % 5 = 0 THEN 'revalidate' ELSE 'act' END"
_GOLD = "CASE WHEN toxic = 1 THEN 'ask' WHEN doc_id % 13 = 0 THEN 'revalidate' ELSE 'act' END"


@query("op_b4_decision_scorer", f"""
WITH p AS (SELECT {_CHOSEN} AS chosen, {_GOLD} AS gold, quality = 0 AS wrong FROM labels),
s AS (SELECT *, CASE WHEN gold IN ('act', 'revalidate') THEN chosen = 'act' AND wrong ELSE chosen = 'act' END AS harmful,
  CASE gold WHEN 'act' THEN chosen <> 'act' WHEN 'revalidate' THEN chosen NOT IN ('act', 'revalidate') ELSE false END AS deferral FROM p)
SELECT gold, count(*) AS n, sum(harmful::INT)::BIGINT AS harmful, sum(deferral::INT)::BIGINT AS deferral, sum((chosen = 'ask')::INT)::BIGINT AS asked,
  round(sum(harmful::INT) / count(*), 9) AS harmful_rate, sum(CASE WHEN gold = 'act' THEN chosen = 'act' AND NOT harmful WHEN gold = 'revalidate' THEN chosen = 'revalidate' OR (chosen = 'act' AND NOT harmful) ELSE chosen = gold END::INT)::BIGINT AS exact
FROM s GROUP BY gold""")
def decision_scorer(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select(F.expr(_CHOSEN).alias("chosen"), F.expr(_GOLD).alias("gold"), (F.col("quality") == 0).alias("wrong"))
    act = F.col("chosen") == "act"
    actable = F.col("gold").isin("act", "revalidate")
    s = p.withColumn("harmful", F.when(actable, act & F.col("wrong")).otherwise(act))
    s = s.withColumn("deferral", F.when(F.col("gold") == "act", ~act).when(F.col("gold") == "revalidate", ~F.col("chosen").isin("act", "revalidate")).otherwise(False))
    exact = F.when(F.col("gold") == "act", act & ~F.col("harmful")).when(F.col("gold") == "revalidate", (F.col("chosen") == "revalidate") | (act & ~F.col("harmful"))).otherwise(F.col("chosen") == F.col("gold"))
    n = F.count(F.lit(1))
    return s.groupBy("gold").agg(
        n.alias("n"), F.count_if("harmful").alias("harmful"), F.count_if("deferral").alias("deferral"), F.count_if(F.col("chosen") == "ask").alias("asked"),
        F.round(F.count_if("harmful") / n, 9).alias("harmful_rate"), F.count_if(exact).alias("exact"),
    )


def wilson(k, n, z: float = 1.959963984540054):
    """(lo, hi) of the Wilson interval of k out of n, rounded to 9 digits."""
    p, den = k / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / den))
    hi = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), (centre + half) / den))
    return F.round(lo, 9), F.round(hi, 9)


@query("op_b5_wilson", """
WITH c AS (SELECT toxic, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k, 1.959963984540054::DOUBLE AS z FROM labels GROUP BY toxic)
SELECT toxic, round(k / n, 9) AS rate, round(CASE WHEN k = 0 THEN 0 ELSE greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 9) AS lo,
  round(CASE WHEN k = n THEN 1 ELSE least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 9) AS hi FROM c""")
def wilson_rates(spark, sf_dir):
    c = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return c.select("toxic", F.round(F.col("k") / F.col("n"), 9).alias("rate"), lo.alias("lo"), hi.alias("hi"))


@query("op_b6_thresholds", """
WITH t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), s AS (SELECT quality, (doc_id * 37 % 100) / 100.0 AS score FROM labels)
SELECT threshold::DOUBLE AS threshold, count(*) FILTER (WHERE quality = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE quality = 0 AND score >= threshold) AS fp,
  count(*) FILTER (WHERE quality = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE quality = 0 AND score < threshold) AS tn FROM s, t GROUP BY 1""")
def thresholds(spark, sf_dir):
    """OP-B6: one pass over the scores; each row meets the four thresholds inside itself."""
    s = table(spark, sf_dir, "labels").select("quality", ((F.col("doc_id") * 37 % 100) / 100.0).alias("score"), F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("threshold"))
    hit, same = F.col("score") >= F.col("threshold"), F.col("quality") == 1
    return s.groupBy("threshold").agg(F.count_if(same & hit).alias("tp"), F.count_if(~same & hit).alias("fp"), F.count_if(same & ~hit).alias("fn"), F.count_if(~same & ~hit).alias("tn"))


@query("op_b7_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(*[F.round(F.percentile("value", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("op_b8_crossover", """
WITH m AS (SELECT avg(value) FILTER (WHERE event_type = 'click') AS a1, avg(value) FILTER (WHERE event_type = 'view') AS a2, avg(value) FILTER (WHERE event_type = 'signup') AS q1, avg(value) FILTER (WHERE event_type = 'purchase') AS q2 FROM events)
SELECT round((a1 - a2) / nullif(q2 - q1, 0), 6) AS r FROM m""")
def crossover(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = {n: F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(n) for n, t in (("a1", "click"), ("a2", "view"), ("q1", "signup"), ("q2", "purchase"))}
    return e.agg(*a.values()).select(F.round((F.col("a1") - F.col("a2")) / F.nullif(F.col("q2") - F.col("q1"), F.lit(0.0)), 6).alias("r"))


@query("op_b10_collapse", oracle("direct", """
SELECT entity, attr, value, grp, min(rid) AS first_rid, count(*) AS reports FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, attr ORDER BY anchor, lsn) - row_number() OVER (PARTITION BY entity, attr, value, grp ORDER BY anchor, lsn) AS island FROM direct) GROUP BY entity, attr, value, grp, island"""))
def collapse(spark, sf_dir):
    """OP-B10: neighbours of one value and one group merged."""
    w = Window.partitionBy("entity", "attr").orderBy("anchor", "lsn")
    d = evidence(spark, sf_dir).withColumn("new", F.coalesce((F.lag("value").over(w) != F.col("value")) | (F.lag("grp").over(w) != F.col("grp")), F.lit(True)).cast("int"))
    d = d.withColumn("island", F.sum("new").over(w))
    return d.groupBy("entity", "attr", "value", "grp", "island").agg(F.min("rid").alias("first_rid"), F.count(F.lit(1)).alias("reports")).drop("island")
