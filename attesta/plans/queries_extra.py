"""Further queries: defaults of reads, derived supports and dependence, attributed segments, audit reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import admission as A
from attesta.operators import integrity as I
from attesta.operators import kernel as K
from attesta.operators import store as T
from attesta.operators.tables import apart, cut
from attesta.plans.ctes import oracle
from attesta.plans.queries_core import DAY, evidence
from attesta.plans.queries_policy import supported
from attesta.plans.registry import query
from attesta.sources.report_log import report_log, table


@query("op_q3_virtual_view", oracle("sthere log", """
SELECT e.entity, coalesce(s.status, 'unknown') AS status, coalesce(s.candidates, '(empty)') AS candidates
FROM (SELECT DISTINCT entity FROM log) e LEFT JOIN (SELECT * FROM sthere WHERE attr = 'employer') s USING (entity)"""))
def virtual_view(spark, sf_dir):
    """OP-Q3: a key without history answers as one without evidence."""
    s = K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY).where("attr = 'employer'").select("entity", "status", "candidates")
    asked = report_log(spark, sf_dir).select("entity").distinct()
    return asked.join(apart(s), "entity", "left").select("entity", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("candidates", F.lit("(empty)")).alias("candidates"))


@query("op_q5_evidence", oracle("ev", "SELECT rid, outcome, reason, by_lsn IS NOT NULL AS withdrawn FROM ev WHERE entity = 'u1-2'"))
def evidence_of(spark, sf_dir):
    """OP-Q5: audit read of one entity."""
    return A.evaluate(report_log(spark, sf_dir)).where("entity = 'u1-2'").select("rid", "outcome", "reason", F.col("by").isNotNull().alias("withdrawn"))


@query("op_q8_verify", oracle("heads", "SELECT 0::BIGINT AS problems, count(*) AS blocks, arg_max(head, block) AS head FROM heads"))
def verify(spark, sf_dir):
    """OP-Q8, OP-V6: the whole chain verifies, block by block, and its last head stands for it."""
    chained = cut(I.chain(report_log(spark, sf_dir)))
    head = I.heads(chained).agg(F.count(F.lit(1)).alias("blocks"), F.max_by("head", "block").alias("head"))
    return I.verify(chained).agg(F.count(F.lit(1)).alias("problems")).crossJoin(F.broadcast(head))  # one row each


_ADM = """
, a AS (SELECT b.lsn, b.k, CASE WHEN k = 13 THEN 'admissible:admitted' ELSE verdict END AS record, CASE WHEN k = 17 THEN repeat('0', 64) ELSE entry_hash END AS report_hash, verdict, entry_hash FROM base b JOIN chained USING (lsn))
SELECT lsn, 'admission_hash_mismatch' AS problem FROM a WHERE record <> verdict OR report_hash <> entry_hash UNION ALL SELECT lsn, 'admission_report_mismatch' FROM a WHERE report_hash <> entry_hash"""


@query("op_v3_verify_admissions", oracle("base chained", _ADM).replace("\n\n, a AS", ",\na AS"))
def verify_admissions(spark, sf_dir):
    """OP-V3: stored admission records, some of them altered after they were hashed (k = 13: the outcome, k = 17: the report)."""
    log = report_log(spark, sf_dir)
    chained = cut(I.chain(log))
    adm = A.own_merit(log).select("lsn", "k", F.concat_ws(":", "outcome", "reason").alias("record")).join(chained.select("lsn", F.col("entry_hash").alias("report_hash")), "lsn")
    adm = adm.withColumn("entry_hash", I.admission_hash(F.col("lsn"), F.col("record"), F.col("report_hash")))
    adm = adm.withColumns({"record": F.when(F.col("k") == 13, "admissible:admitted").otherwise(F.col("record")), "report_hash": F.when(F.col("k") == 17, I.GENESIS).otherwise(F.col("report_hash"))})
    return I.verify_admissions(cut(adm), chained)


@query("op_v5_verify_beliefs", oracle("sthere keyn gen", """
SELECT s.entity, s.attr FROM sthere s JOIN keyn k USING (entity, attr) JOIN gen g USING (entity, attr)
WHERE k.n % 3 = 0 AND NOT coalesce(g.completed, 0) < g.required AND (s.candidates IS NULL OR s.candidates <> 'v9')"""))
def verify_beliefs(spark, sf_dir):
    """OP-V5: stored beliefs, those of keys with a number of reports divisible by three altered, against beliefs computed again."""
    fresh = cut(K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY))
    stored = fresh.withColumn("candidates", F.when(F.col("n") % 3 == 0, "v9").otherwise(F.col("candidates")))
    stale = T.generations(report_log(spark, sf_dir)).where("coalesce(completed, 0) < required")
    return I.verify_beliefs(stored, fresh, stale)


@query("op_r7_attribution_segments", oracle("ev direct", """
SELECT entity, attr, CASE WHEN count(DISTINCT holder || '|' || value) = 1 THEN 'established' ELSE 'unresolved' END AS status, string_agg(DISTINCT holder || ':' || value, '|' ORDER BY holder || ':' || value) AS candidates
FROM ev e WHERE outcome = 'admissible' AND by_lsn IS NULL AND form = 'belief_of' AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.entity = e.entity AND d.attr = e.attr) GROUP BY 1, 2"""))
def attribution_segments(spark, sf_dir):
    """OP-R7: keys that only attributed claims speak of; the attribution is justified, never its content."""
    ev = cut(A.evaluate(report_log(spark, sf_dir)))
    said = ev.where("outcome = 'admissible' and by is null and form = 'belief_of'").join(A.direct(ev).select("entity", "attr").distinct(), ["entity", "attr"], "left_anti")
    claims = F.array_sort(F.collect_set(F.concat_ws(":", "holder", "value")))
    return said.groupBy("entity", "attr").agg(claims.alias("c")).select("entity", "attr", F.when(F.size("c") == 1, "established").otherwise("unresolved").alias("status"), F.array_join("c", "|").alias("candidates"))


@query("op_p5_derived_environments", oracle("mday", """
, hq AS (SELECT v, c, sid FROM (SELECT 'v' || (s_suppkey % 3) AS v, 'c' || (s_nationkey % 4) AS c, 's' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS sid, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier) WHERE n <= 5),
j AS (SELECT DISTINCT m.entity, hq.c AS city, list_sort(list_append(m.env, hq.sid)) AS env FROM mday m JOIN hq ON hq.v = m.cand WHERE m.attr = 'employer')
SELECT entity, city, array_to_string(env, ',') AS env FROM j a
WHERE NOT EXISTS (SELECT 1 FROM j b WHERE b.entity = a.entity AND b.city = a.city AND len(b.env) < len(a.env) AND list_has_all(a.env, b.env))""").replace("\n\n, hq", ",\nhq"))
def derived_environments(spark, sf_dir):
    """OP-P4, OP-P5: environments of work_city: one of the employer's joined with one report of the head office, then minimised."""
    from pyspark.sql import Window

    emp = supported(spark, sf_dir, "attr = 'employer'").select("entity", F.explode_outer("sup").alias("s")).select("entity", F.col("s.world").alias("v"), F.explode_outer("s.envs").alias("e"))
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string")).alias("v"), F.concat(F.lit("c"), (F.col("s_nationkey") % 4).cast("string")).alias("city"), "s_suppkey",
        F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("sid"),
    )
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("s_suppkey"))).where("n <= 5").select("v", "city", "sid")
    # five reports of each of three companies
    joined = emp.join(F.broadcast(s), "v").select("entity", "city", F.array_sort(F.array_append(F.split("e", ","), F.col("sid"))).alias("env"))
    sets = joined.groupBy("entity", "city").agg(F.collect_set("env").alias("envs"))
    least = F.expr("filter(envs, a -> not exists(envs, b -> size(b) < size(a) and size(array_except(b, a)) = 0))")
    return sets.select("entity", "city", F.explode_outer(least).alias("env")).select("entity", "city", F.array_join("env", ",").alias("env"))


@query("op_d6_relevant_keys", oracle("fam", """
SELECT DISTINCT entity AS head, 'employer/' || entity AS reads FROM fam WHERE attr = 'employer'
UNION SELECT DISTINCT entity, 'hq_city/' || world FROM fam WHERE attr = 'employer' AND world <> '' AND (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)"""))
def relevant_keys(spark, sf_dir):
    """OP-D6, OP-R3: the keys that work_city of each entity can read on the day."""
    inter = cut(K.interpretations(evidence(spark, sf_dir)).where("not limited and attr = 'employer'"))
    own = inter.select(F.col("entity").alias("head"), F.concat(F.lit("employer/"), "entity").alias("reads"))
    via = inter.select("entity", F.explode_outer(F.expr(K.family(str(DAY)))).alias("w")).where("w <> ''").select(F.col("entity").alias("head"), F.concat(F.lit("hq_city/"), "w").alias("reads"))
    return own.unionByName(via).distinct()


@query("op_d7_derived_breakpoints", oracle("days", "SELECT DISTINCT entity, CAST(d AS INT) AS day FROM days WHERE attr IN ('employer', 'birthplace')"))
def derived_breakpoints(spark, sf_dir):
    """OP-D7: days at which a value derived from employer and birthplace can change."""
    p = K.pieces(K.interpretations(evidence(spark, sf_dir))).where("lo is not null and attr in ('employer', 'birthplace')")
    return p.select("entity", F.col("lo").alias("day")).distinct()


@query("op_a16_exclusion_decisions", oracle("log", """
SELECT 's' || (lsn % 7) AS source_id, max(lsn) AS marker_lsn, arg_max(CASE WHEN lsn % 2 = 0 THEN 'exclude' ELSE 'restore' END, lsn) AS op FROM log WHERE cue = 'assert' AND k = 95 GROUP BY 1"""))
def exclusion_decisions(spark, sf_dir):
    m = report_log(spark, sf_dir).where("cue = 'assert' and k = 95").withColumn("source_id", F.concat(F.lit("s"), (F.col("lsn") % 7).cast("string")))
    return m.groupBy("source_id").agg(F.max("lsn").alias("marker_lsn"), F.max_by(F.when(F.col("lsn") % 2 == 0, "exclude").otherwise("restore"), "lsn").alias("op"))


@query("op_r6_recompute_key", oracle("sthere", "SELECT entity, attr, status, candidates FROM sthere WHERE entity LIKE 'u1-%'"))
def recompute_key(spark, sf_dir):
    """OP-R6: the pipeline restricted to some keys by a semi-join ahead of the kernel."""
    d = evidence(spark, sf_dir)
    some = d.where(F.col("entity").like("u1-%")).select("entity", "attr").distinct()
    return K.status_at(K.interpretations(d.join(some, ["entity", "attr"], "left_semi")), DAY).select("entity", "attr", "status", "candidates")


@query("op_s15_table_store", oracle("log", "SELECT attr, count(*) AS rows, min(lsn) AS first, max(lsn) AS last FROM log GROUP BY 1"))
def table_store(spark, sf_dir):
    """OP-S14, OP-S15: the log written as a table and read back."""
    return cut(report_log(spark, sf_dir)).groupBy("attr").agg(F.count(F.lit(1)).alias("rows"), F.min("lsn").alias("first"), F.max("lsn").alias("last"))


@query("op_s11_version_handles", oracle("log", "SELECT entity || '/' || attr || '@' || count(*) AS handle FROM log GROUP BY entity, attr"))
def version_handles(spark, sf_dir):
    """OP-S11: handle of the current version of each key."""
    v = T.versions(report_log(spark, sf_dir)).groupBy("entity", "attr").agg(F.max("version").alias("version"))
    return v.select(F.concat("entity", F.lit("/"), "attr", F.lit("@"), F.col("version").cast("string")).alias("handle"))


@query("op_e8_honoured_merges", oracle("ev", "SELECT rid FROM ev WHERE k % 10 = 5 AND outcome = 'admissible' AND by_lsn IS NULL AND cue = 'assert' AND actor NOT LIKE 'agent:%'"))
def honoured_merges(spark, sf_dir):
    """OP-E8: marker reports (here: k ending in 5) that the host stands behind."""
    return A.evaluate(report_log(spark, sf_dir)).where("k % 10 = 5 and outcome = 'admissible' and by is null and cue = 'assert' and actor not like 'agent:%'").select("rid")


@query("op_e15_find_with_status", oracle("sthere", """
SELECT split_part(entity, '-', 1) AS name, count(*) AS keys, count(*) FILTER (WHERE status = 'established') AS established FROM sthere WHERE attr = 'employer' GROUP BY 1 ORDER BY established DESC, name LIMIT 10"""))
def find_with_status(spark, sf_dir):
    """OP-E15: the ten entities with most established keys, classes collapsed."""
    s = K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY).where("attr = 'employer'")
    by = s.groupBy(F.split_part("entity", F.lit("-"), F.lit(1)).alias("name")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("status") == "established").alias("established"))
    return by.orderBy(F.desc("established"), "name").limit(10)
