"""Queries over the store: scans, writes, export, integrity, revision, outbox; scalars; rules; entities; extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions import scalars as S
from attesta.operators import admission as A
from attesta.operators import entities as E
from attesta.operators import integrity as I
from attesta.operators import kernel as K
from attesta.operators import rules as R
from attesta.operators import store as T
from attesta.operators.tables import cut
from attesta.plans.ctes import cte, oracle
from attesta.plans.queries_core import DAY, evidence
from attesta.plans.registry import query
from attesta.sources.report_log import EVIDENCE, report_log, table


@query("op_s2_idempotent_append", oracle("log", """
, h AS (SELECT entity || '/' || k AS idem, min(lsn) AS lsn, arg_min(coalesce(value, ''), lsn) AS value FROM log WHERE lsn <= 500 GROUP BY 1),
b AS (SELECT entity || '/' || k AS idem, min(lsn) AS lsn, arg_min(coalesce(value, ''), lsn) AS value FROM log WHERE lsn > 500 GROUP BY 1)
SELECT CASE WHEN h.idem IS NULL THEN 'new' WHEN h.value = b.value THEN 'replay' ELSE 'conflict' END AS outcome, count(*) AS n FROM b LEFT JOIN h USING (idem) GROUP BY 1""").replace("\n\n, h AS", ",\nh AS"))
def idempotent(spark, sf_dir):
    """OP-S1, OP-S2: a batch against the stored rows by idempotency key: new, replayed or conflicting."""
    log = report_log(spark, sf_dir).withColumn("idem", F.concat_ws("/", "entity", F.col("k").cast("string"))).withColumn("content", F.coalesce("value", F.lit("")))
    return T.match_batch(log.where("lsn <= 500"), log.where("lsn > 500")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("op_s3_monotone_time", oracle("log", "SELECT lsn, epoch_us(max(recorded_at - to_hours(k % 3)) OVER (ORDER BY lsn)) AS recorded FROM log"))
def monotone_time(spark, sf_dir):
    log = report_log(spark, sf_dir).select("lsn", (F.col("recorded_at") - F.make_dt_interval(F.lit(0), F.col("k") % 3)).alias("clock"))
    return T.running_max(log, "lsn", "clock").select("lsn", F.unix_micros(F.col("upto").cast("timestamp_ltz")).alias("recorded"))


@query("op_s4_range_scan", oracle("log", "SELECT lsn, rid, cue FROM log WHERE lsn BETWEEN 200 AND 400"))
def range_scan(spark, sf_dir):
    return report_log(spark, sf_dir, 400).where("lsn between 200 and 400").select("lsn", "rid", "cue")


@query("op_s5_point_lookup", oracle("log", "SELECT rid, entity, attr, cue FROM log WHERE rid IN ('r0000000007', 'r0000000300')"))
def point_lookup(spark, sf_dir):
    return report_log(spark, sf_dir).where(F.col("rid").isin("r0000000007", "r0000000300")).select("rid", "entity", "attr", "cue")


@query("op_s6_key_scan", oracle("log", "SELECT rid, cue, value FROM log WHERE entity = (SELECT max(entity) FROM log WHERE attr = 'employer') AND attr = 'employer' AND lsn <= (SELECT max(lsn) FROM log) - 100"))
def key_scan(spark, sf_dir):
    """OP-S6: the reports of one key (of the last entity by name) up to a position near the end."""
    log = report_log(spark, sf_dir).where("attr = 'employer'")
    asked = log.agg(F.max("entity").alias("entity"))
    end = table(spark, sf_dir, "events").agg((F.max("event_id") + 1 - 100).alias("end"))
    return log.join(F.broadcast(asked), "entity", "left_semi").crossJoin(F.broadcast(end)).where("lsn <= end").select("rid", "cue", "value")  # one row each


@query("op_s7_lsn_at", oracle("log", "SELECT CAST(d AS VARCHAR) AS day, (SELECT max(lsn) FROM log WHERE recorded_at <= d) AS lsn FROM (SELECT unnest([DATE '2024-01-05', DATE '2024-01-15', DATE '2024-01-25'])::TIMESTAMP AS d)").replace("CAST(d AS VARCHAR)", "strftime(d, '%Y-%m-%d')"))
def lsn_at(spark, sf_dir):
    """OP-S7, OP-J7: the last position recorded by each of three times."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), "ts")
    days = ("2024-01-05", "2024-01-15", "2024-01-25")
    one = e.agg(*[F.max(F.when(F.col("ts") <= F.to_timestamp(F.lit(d)), F.col("lsn"))).alias(d) for d in days])
    return one.select(F.explode(F.create_map(*[x for d in days for x in (F.lit(d), F.col(f"`{d}`"))])).alias("day", "lsn"))


@query("op_s8_input_at", oracle("log", "SELECT source_id, max(k) AS version, arg_max(rid, k * 1000000000::BIGINT + lsn) AS payload FROM log WHERE lsn <= 600 GROUP BY 1"))
def input_at(spark, sf_dir):
    """OP-S8: the payload of the greatest version in effect by a position (versions: k per source)."""
    log = report_log(spark, sf_dir, 600)
    return log.groupBy("source_id").agg(F.max("k").alias("version"), F.max_by("rid", F.struct("k", "lsn")).alias("payload"))


@query("op_s9_input_guard", oracle("log", "SELECT lsn FROM (SELECT lsn, k, max(k) OVER (PARTITION BY entity, attr ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM log) WHERE k <= m"))
def input_guard(spark, sf_dir):
    """OP-S9: writes whose version does not exceed the greatest before them (versions: k per key)."""
    w = Window.partitionBy("entity", "attr").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    return report_log(spark, sf_dir).withColumn("m", F.max("k").over(w)).where("k <= m").select("lsn")


@query("op_s10_belief_as_of", oracle("log", "SELECT entity, attr, max(lsn) AS lsn, arg_max(rid, lsn) AS rid, count(*) AS version FROM log WHERE lsn <= 650 GROUP BY 1, 2"))
def belief_as_of(spark, sf_dir):
    """OP-S10, OP-S11: the version of each key in force at a position (one version per report)."""
    return report_log(spark, sf_dir, 650).groupBy("entity", "attr").agg(F.max("lsn").alias("lsn"), F.max_by("rid", "lsn").alias("rid"), F.count(F.lit(1)).alias("version"))


@query("op_s12_export_jsonl", oracle("log", """SELECT lsn, '{"attr":"' || attr || '","cue":"' || cue || '","entity":"' || entity || '","lsn":' || lsn || ',"value":' || coalesce('"' || value || '"', 'null') || '}' AS line FROM log"""))
def export_jsonl(spark, sf_dir):
    return T.export_lines(report_log(spark, sf_dir))


@query("op_s13_import_jsonl", oracle("log", "SELECT count(*) AS rows, count(DISTINCT lsn) AS positions, max(lsn) - count(*) AS gaps, count(value) AS vals FROM log"))
def import_jsonl(spark, sf_dir):
    """OP-S13: the exported lines read back and checked."""
    back = T.import_lines(T.export_lines(report_log(spark, sf_dir)))
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("lsn").alias("positions"), (F.max("lsn") - F.count(F.lit(1))).alias("gaps"), F.count("value").alias("vals"))


@query("op_s16_derived_id", oracle("log", "SELECT rid, substr(sha256(rid || '|1|' || cue), 1, 26) AS id FROM log"))
def derived_id(spark, sf_dir):
    return report_log(spark, sf_dir).select("rid", S.derived_id("rid", F.lit("1"), "cue").alias("id"))


@query("op_s18_subscriptions", oracle("log", "SELECT 'p' || (k % 3) AS plan, count(DISTINCT entity || '/' || attr) AS keys FROM log WHERE k % 5 = 0 GROUP BY 1"))
def subscriptions(spark, sf_dir):
    return T.subscriptions(report_log(spark, sf_dir)).groupBy("plan").agg(F.count(F.lit(1)).alias("keys"))


@query("op_s19_outbox", oracle("log", """
, s AS (SELECT DISTINCT 'p' || (k % 3) AS plan, entity, attr FROM log WHERE k % 5 = 0),
v AS (SELECT entity, attr, lsn, row_number() OVER (PARTITION BY entity, attr ORDER BY lsn) AS version FROM log)
SELECT plan, sha256(plan || '|' || entity || '|' || attr || '|' || (version - 1) || '|' || version) AS event_id FROM s JOIN v USING (entity, attr) WHERE lsn > 900""").replace("\n\n, s AS", ",\ns AS"))
def outbox(spark, sf_dir):
    """OP-S19: one event per plan and version change after position 900, with a stable id."""
    log = report_log(spark, sf_dir)
    return T.outbox(T.versions(log).where("lsn > 900"), T.subscriptions(log)).select("plan", "event_id")


_BENT = """
SELECT rid, CASE WHEN k % 17 = 0 THEN NULL ELSE value END AS value, CASE WHEN k % 19 = 0 THEN lsn ELSE target END AS target, cue, CASE WHEN k % 23 = 0 THEN 'v9' ELSE change_from END AS change_from, origin, form, lsn, attr FROM log"""


@query("op_t1_well_formed", oracle("log", f"""
SELECT rid, concat_ws(',', CASE WHEN cue IN ('correct', 'withdraw', 'dispute', 'allege') AND target IS NULL THEN 'target_required' END, CASE WHEN cue IN ('assert', 'change') AND target IS NOT NULL THEN 'target_forbidden' END,
  CASE WHEN target = lsn THEN 'self_target' END, CASE WHEN cue IN ('assert', 'change', 'correct') AND value IS NULL THEN 'proposition_required' END, CASE WHEN change_from IS NOT NULL AND cue <> 'change' THEN 'change_from' END) AS problems FROM ({_BENT})"""))
def well_formed(spark, sf_dir):
    """OP-T1 over a log bent on purpose."""
    k = F.col("k")
    bent = report_log(spark, sf_dir).withColumns({"value": F.when(k % 17 != 0, F.col("value")), "target": F.when(k % 19 == 0, F.col("lsn")).otherwise(F.col("target")), "change_from": F.when(k % 23 == 0, "v9").otherwise(F.col("change_from"))})
    return bent.select("rid", S.problems().alias("problems"))


@query("op_t2_form_vs_class", oracle("log", "SELECT form, attr, CASE WHEN attr = 'tags' THEN form IN ('member', 'not_member', 'enumeration', 'belief_of') ELSE form IN ('value', 'not_value', 'belief_of') END AS fits, count(*) AS n FROM (SELECT CASE WHEN k % 13 = 0 THEN 'member' ELSE form END AS form, attr FROM log WHERE form IS NOT NULL) GROUP BY ALL"))
def form_vs_class(spark, sf_dir):
    log = report_log(spark, sf_dir).where("form is not null").withColumn("form", F.when(F.col("k") % 13 == 0, "member").otherwise(F.col("form")))
    return log.groupBy("form", "attr", S.form_fits(F.col("form"), F.col("attr")).alias("fits")).agg(F.count(F.lit(1)).alias("n"))


@query("op_t3_write_guard", oracle("log", "SELECT CASE WHEN k % 10 = 3 THEN 'work_city' WHEN k % 10 = 4 THEN 'shoe_size' ELSE attr END AS a, count(*) AS n, CASE WHEN a = 'work_city' THEN 'derived' WHEN a = 'shoe_size' THEN 'undeclared' END AS refused FROM log WHERE cue IN ('assert', 'change', 'correct') GROUP BY 1"))
def write_guard(spark, sf_dir):
    k = F.col("k") % 10
    log = report_log(spark, sf_dir).where(F.col("cue").isin(*EVIDENCE)).withColumn("a", F.when(k == 3, "work_city").when(k == 4, "shoe_size").otherwise(F.col("attr")))
    return log.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", S.refused(F.col("a")))


@query("op_t4_normalise")
def normalise(spark, sf_dir):
    """OP-T4 (NFKC and case folding: an Arrow function, no SQL)."""
    return table(spark, sf_dir, "part").select("p_partkey", S.normalise(F.concat(F.lit("  Ｆ"), F.upper("p_name"), F.lit(" Straße "))).alias("norm"))


@query("op_t5_signature", oracle("log", """SELECT rid, CASE WHEN form = 'belief_of' THEN '{"form":"belief_of","holder":"' || holder || '","proposition":{"form":"value","v":"' || value || '"}}' ELSE '{"form":"' || form || '","v":"' || value || '"}' END AS signature FROM log WHERE form IS NOT NULL"""))
def signature(spark, sf_dir):
    """OP-T5, OP-T6: canonical text of propositions."""
    return report_log(spark, sf_dir).where("form is not null").select("rid", S.canonical_proposition().alias("signature"))


@query("op_t7_canonical_set", oracle("log", "SELECT entity, attr, string_agg(DISTINCT value, ',' ORDER BY value) AS vals FROM log WHERE value IS NOT NULL GROUP BY 1, 2"))
def canonical_set(spark, sf_dir):
    return report_log(spark, sf_dir).where("value is not null").groupBy("entity", "attr").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("value"))), ",").alias("vals"))


@query("op_t8_candidate_id", oracle("log", """SELECT DISTINCT entity, attr, value, sha256('{"form":{"form":"value","value":"' || value || '"},"key":{"attr":"' || attr || '","entity":"' || entity || '"}}') AS id FROM log WHERE form = 'value'"""))
def candidate_id(spark, sf_dir):
    return report_log(spark, sf_dir).where("form = 'value'").select("entity", "attr", "value", S.candidate_id().alias("id")).distinct()


@query("op_t10_stated_date", """
WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END AS raw FROM events)
SELECT event_id, CASE length(raw) WHEN 10 THEN raw WHEN 7 THEN raw || '-01' WHEN 4 THEN CASE WHEN raw = 'soon' THEN NULL ELSE raw || '-01-01' END END AS day, CASE WHEN raw = 'soon' THEN NULL ELSE CASE length(raw) WHEN 10 THEN 'day' WHEN 7 THEN 'month' ELSE 'year' END END AS precision FROM s""")
def stated_date(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.date_format("ts", "yyyy")).when(m == 1, F.date_format("ts", "yyyy-MM")).when(m == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon")
    day, precision = S.stated_date(F.col("raw"))
    return e.select("event_id", raw.alias("raw")).select("event_id", day.alias("day"), precision.alias("precision"))


@query("op_t11_principal", oracle("log", "SELECT actor, split_part(actor, ':', 1) AS kind, split_part(actor, ':', 2) AS name, count(*) AS n FROM log GROUP BY 1"))
def principal(spark, sf_dir):
    kind, name = S.principal(F.col("actor"))
    return report_log(spark, sf_dir).groupBy("actor").agg(F.count(F.lit(1)).alias("n")).withColumns({"kind": kind, "name": name})


@query("op_t12_glob", oracle("log", "SELECT DISTINCT entity FROM log WHERE entity GLOB 'u1?-*'"))
def glob(spark, sf_dir):
    return report_log(spark, sf_dir).where(F.col("entity").rlike(A.glob("u1?-*"))).select("entity").distinct()


@query("op_t13_strict_json", """SELECT event_id, k IS NOT NULL AS complete, '' AS unknown FROM (SELECT event_id, regexp_extract(props, '"k": ?([0-9]+)', 1) AS k FROM events)""")
def strict_json(spark, sf_dir):
    complete, unknown = S.strict_json(F.col("props"), required=("k",), optional=())
    return table(spark, sf_dir, "events").select("event_id", complete.alias("complete"), unknown.alias("unknown"))


_GRAMS = "list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))"


@query("op_t16_dice", f"""
WITH n AS (SELECT DISTINCT p_name FROM part), g AS (SELECT p_name, {_GRAMS.replace('s)', "' ' || p_name || ' ')").replace('(s,', "(' ' || p_name || ' ',")} AS g FROM n)
SELECT a.p_name AS a, b.p_name AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), 9) AS dice FROM g a JOIN g b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name < b.p_name""")
def dice(spark, sf_dir):
    """OP-T16: trigram overlap of names that share their first word."""
    n = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w"), S.ngrams(F.col("p_name")).alias("g"))
    b = n.select(F.col("p_name").alias("b"), "w", F.col("g").alias("gb"))
    return n.join(b, "w").where("p_name < b").select(F.col("p_name").alias("a"), "b", F.round(S.dice(F.col("g"), F.col("gb")), 9).alias("dice"))


@query("op_t17_osa")
def osa(spark, sf_dir):
    """OP-T17: swaps of neighbours cost one, but a pair is edited once; the SQL function of that name is another distance."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w")).distinct()
    return n.join(n.withColumnRenamed("a", "b"), "w").where("a < b").select("a", "b", S.osa_distance("a", "b").alias("d"))


@query("op_t18_span_support", """
SELECT conv_id, turn, contains(lower(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), lower(regexp_replace(substr(text, 5, 12), '[ \\t\\n\\r]+', ' ', 'g'))) AS supported FROM conversations WHERE text IS NOT NULL""")
def span_support(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    return c.select("conv_id", "turn", S.span_supported(F.col("text"), F.substring("text", 5, 12)).alias("supported"))


@query("op_t19_lenient_json", """SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events""")
def lenient_json(spark, sf_dir):
    """OP-T19: one JSON object recovered from a fence or from prose."""
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked.")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(S.recovered_json(raw), "$.k").cast("int").alias("k"))


_WORK = oracle("fam", """
, hq0 AS (SELECT 'v' || (s_suppkey % 3) AS v, 'c' || (s_nationkey % 4) AS c, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS n FROM supplier),
hq AS (SELECT DISTINCT v, c FROM hq0 WHERE n <= 5),
f AS (SELECT entity, attr, world FROM fam WHERE (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)),
w AS (SELECT DISTINCT f.entity, f.attr, f.world AS via, coalesce(hq.c, '') AS city FROM f LEFT JOIN hq ON hq.v = f.world WHERE f.attr <> 'tags')
""").replace("\n\n, hq0", ",\nhq0")


@query("op_d1_rule_worlds", _WORK + "SELECT entity, via, city FROM w WHERE attr = 'employer'")
def rule_worlds(spark, sf_dir):
    """OP-D1: work_city(e, c) from employer(e, x) and hq_city(x, c), world by world."""
    f = R.family_rows(K.interpretations(evidence(spark, sf_dir)), DAY)
    return R.lookup_rule(f.where("attr = 'employer'"), R.head_offices(table(spark, sf_dir, "supplier")))


@query("op_d2_rules_per_head", _WORK + """
, a AS (SELECT DISTINCT entity, city FROM w WHERE attr = 'employer'), b AS (SELECT DISTINCT entity, city FROM w WHERE attr = 'birthplace')
SELECT DISTINCT entity, array_to_string(list_sort(list_distinct(list_filter([coalesce(a.city, ''), coalesce(b.city, '')], lambda x: x <> ''))), '+') AS world FROM a FULL JOIN b USING (entity)""".replace("\n, a AS", ", a AS"))
def rules_per_head(spark, sf_dir):
    """OP-D2: two rules for one head give the unions of their worlds, per entity."""
    f = R.family_rows(K.interpretations(evidence(spark, sf_dir)), DAY)
    hq = R.head_offices(table(spark, sf_dir, "supplier"))
    one = R.lookup_rule(f.where("attr = 'employer'"), hq).select("entity", F.col("city").alias("a")).distinct()
    two = R.lookup_rule(f.where("attr = 'birthplace'"), hq).select("entity", F.col("city").alias("b")).distinct()
    return R.cross_union(one, two, "a", "b")


@query("op_d4_exceptions", _WORK + """
, x AS (SELECT entity, world AS bx FROM f WHERE attr = 'birthplace')
SELECT DISTINCT entity, CASE WHEN coalesce(bx, '') = 'v0' THEN '' ELSE city END AS world FROM w LEFT JOIN x USING (entity) WHERE w.attr = 'employer'""")
def exceptions(spark, sf_dir):
    """OP-D4 (compat): a world of birthplace that holds v0 blocks the head."""
    f = R.family_rows(K.interpretations(evidence(spark, sf_dir)), DAY)
    head = R.lookup_rule(f.where("attr = 'employer'"), R.head_offices(table(spark, sf_dir, "supplier"))).select("entity", "city")
    exc = f.where("attr = 'birthplace'").select("entity", F.col("world").alias("bx"))
    return head.join(exc, "entity", "left").select("entity", F.when(F.col("bx") == "v0", "").otherwise(F.col("city")).alias("world")).distinct()


_EDGES = "e(head, body) AS (VALUES ('work_city', 'employer'), ('work_city', 'hq_city'), ('tax_zone', 'work_city'), ('tax_zone', 'birthplace'), ('office', 'employer'))"


@query("op_d8_closure", f"WITH RECURSIVE {_EDGES}, c AS (SELECT head, body FROM e UNION SELECT c.head, e.body FROM c JOIN e ON e.head = c.body) SELECT head, body FROM c WHERE body NOT IN (SELECT head FROM e)")
def closure(spark, sf_dir):
    """OP-D8: base attributes each derived attribute can read."""
    return R.closure(R.rule_edges(spark)).where("base").select("head", "body")


@query("op_d9_overlaps", f"""WITH RECURSIVE {_EDGES}, f AS (SELECT * FROM e UNION ALL VALUES ('bonus', 'tax_zone'), ('bonus', 'office'), ('bonus', 'tags')),
c AS (SELECT head, body FROM f UNION SELECT c.head, f.body FROM c JOIN f ON f.head = c.body), r AS (SELECT head AS x, body AS b FROM c WHERE body NOT IN (SELECT head FROM f) UNION SELECT body, body FROM f WHERE body NOT IN (SELECT head FROM f))
SELECT DISTINCT a.head, a.body AS x, b.body AS y FROM f a JOIN f b ON a.head = b.head AND a.body < b.body JOIN r p ON p.x = a.body JOIN r q ON q.x = b.body AND q.b = p.b""")
def overlaps(spark, sf_dir):
    """OP-D9: pairs of literals of one rule whose closures meet: none in the schema, some in one with a rule more."""
    more = spark.createDataFrame([("bonus", "tax_zone"), ("bonus", "office"), ("bonus", "tags")], "head string, body string")
    return R.overlaps(R.rule_edges(spark).unionByName(more))


@query("op_d11_depth", f"WITH RECURSIVE {_EDGES}, c(head, body, depth) AS (SELECT head, body, 1 FROM e UNION ALL SELECT c.head, e.body, depth + 1 FROM c JOIN e ON e.head = c.body) SELECT head, max(depth)::INT AS depth FROM c GROUP BY 1")
def depth(spark, sf_dir):
    return R.closure(R.rule_edges(spark)).groupBy("head").agg(F.max("depth").alias("depth"))


@query("op_d14_dependents", oracle("fam", """
, f AS (SELECT entity, world FROM fam WHERE attr = 'employer' AND (lo IS NULL OR lo <= -717) AND (hi IS NULL OR hi > -717)) SELECT DISTINCT entity AS head_entity FROM f WHERE world IN ('v1', 'v2')""").replace("\n\n, f AS", ",\nf AS"))
def dependents(spark, sf_dir):
    """OP-D12, OP-D13, OP-D14: heads that may read the changed keys hq_city(v1), hq_city(v2), through the value index."""
    f = R.family_rows(K.interpretations(evidence(spark, sf_dir)), DAY)
    return R.dependents(f.where("attr = 'employer'"), spark.createDataFrame([("v1",), ("v2",)], "changed string"))


@query("op_d15_dependency_closure", oracle("log", """
SELECT count(DISTINCT lsn) AS reached FROM (WITH RECURSIVE r AS (SELECT lsn FROM log WHERE lsn <= 50 UNION SELECT l.lsn FROM log l JOIN r ON l.target = r.lsn) SELECT lsn FROM r)"""))
def dependency_closure(spark, sf_dir):
    """OP-D15, OP-R8: everything that depends on the first fifty reports through targets, by a frontier loop."""
    log = report_log(spark, sf_dir)
    edges = log.where("target > 0").select(F.col("target").alias("src"), F.col("lsn").alias("dst"))
    return R.reach(edges, log.where("lsn <= 50").select(F.col("lsn").alias("node"))).agg(F.count(F.lit(1)).alias("reached"))


@query("op_d16_components", f"WITH RECURSIVE {_EDGES}, b AS (SELECT head AS x, body AS y FROM e UNION SELECT body, head FROM e), c AS (SELECT x, x AS y FROM b UNION SELECT c.x, b.y FROM c JOIN b ON b.x = c.y) SELECT x AS attr, min(y) AS component FROM c GROUP BY 1")
def attr_components(spark, sf_dir):
    return R.components(R.rule_edges(spark))


@query("op_r1_touched_keys")
def touched_keys(spark, sf_dir):
    """OP-R1: keys whose direct evidence differs between positions 900 and 950."""
    return T.touched(evidence(spark, sf_dir, 900), evidence(spark, sf_dir, 950))


@query("op_r5_revision_budget", oracle("log", "SELECT entity, attr, lsn FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY lsn) AS n FROM log) WHERE n <= 3"))
def revision_budget(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("lsn")
    return report_log(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 3").select("entity", "attr", "lsn")


@query("op_r10_barrier_read", oracle("gen", """
SELECT entity, attr, CASE WHEN dirty THEN 'store_dirty' WHEN completed IS NULL THEN 'stale_dependency' WHEN erased THEN 'not_reconstructable' WHEN incomplete THEN 'inference_incomplete' WHEN required > completed THEN 'stale_dependency' ELSE 'belief' END AS outcome FROM gen"""))
def barrier_read(spark, sf_dir):
    """OP-R8, OP-R9, OP-R10, OP-Q4: what a read of each key answers under the generation barrier."""
    return T.barrier(T.generations(report_log(spark, sf_dir)))


@query("op_r11_stale_walk", oracle("log", """
SELECT root, count(*) AS chain FROM (WITH RECURSIVE r AS (SELECT lsn AS root, target FROM log WHERE target > 0 UNION ALL SELECT r.root, l.target FROM r JOIN log l ON l.lsn = r.target AND l.target > 0) SELECT root, target FROM r) GROUP BY 1"""))
def stale_walk(spark, sf_dir):
    """OP-R11: how many reports each report depends on through its chain of targets."""
    edges = report_log(spark, sf_dir).where("target > 0").select(F.col("lsn").alias("src"), F.col("target").alias("dst"))
    return R.chain_lengths(edges)


@query("op_r12_completion_jobs", oracle("gen", "SELECT entity, attr, required AS generation FROM gen WHERE coalesce(completed, 0) < required"))
def completion_jobs(spark, sf_dir):
    return T.generations(report_log(spark, sf_dir)).where("coalesce(completed, 0) < required").select("entity", "attr", F.col("required").alias("generation"))


@query("op_r13_version_stamp", oracle("log", "SELECT rid, row_number() OVER (PARTITION BY entity, attr ORDER BY lsn) AS version FROM log"))
def version_stamp(spark, sf_dir):
    return T.versions(report_log(spark, sf_dir)).select("rid", F.col("version").cast("long").alias("version"))


@query("op_r14_recovery_invariants", oracle("log", "SELECT max(lsn) - count(*) AS gaps, count(*) - count(DISTINCT lsn) AS repeats, count(*) FILTER (WHERE target >= lsn) AS forward_targets FROM log"))
def recovery(spark, sf_dir):
    return report_log(spark, sf_dir).agg((F.max("lsn") - F.count(F.lit(1))).alias("gaps"), (F.count(F.lit(1)) - F.count_distinct("lsn")).alias("repeats"), F.count_if(F.coalesce(F.col("target") >= F.col("lsn"), F.lit(False))).alias("forward_targets"))


@query("op_r15_erasure", oracle("log", "SELECT entity, attr, count(*) FILTER (WHERE k % 37 <> 0) AS live, count(*) FILTER (WHERE k % 37 = 0) AS tombstones FROM log GROUP BY 1, 2 HAVING tombstones > 0"))
def erasure(spark, sf_dir):
    """OP-R15: keys to recompute once the reports with k divisible by 37 are erased."""
    log = report_log(spark, sf_dir)
    return T.erase(log, log.where("k % 37 = 0").select("lsn"))


@query("op_r16_pseudonym")
def pseudonym(spark, sf_dir):
    """OP-R16, OP-V7: HMAC names (an Arrow function; there is no built-in)."""
    return report_log(spark, sf_dir).select("entity").distinct().select("entity", I.hmac_name(F.col("entity")).alias("pseudonym"))


@query("op_v1_commitment", oracle("log", "SELECT rid, sha256('salt' || lsn || '|' || entity || '|' || attr || '|' || cue || '|' || coalesce(value, '')) AS commitment FROM log"))
def commitment(spark, sf_dir):
    return report_log(spark, sf_dir).select("rid", I.commitment().alias("commitment"))


_TAMPER = """
, t AS (SELECT lsn, block, commitment, prev_hash, CASE WHEN lsn % 2000 = 200 THEN sha256('x') ELSE entry_hash END AS entry_hash FROM chained WHERE lsn % 3000 <> 7)
SELECT 'entry_hash' AS problem, lsn FROM t c WHERE entry_hash <> sha256('log.v1' || chr(10) || prev_hash || chr(10) || lsn || chr(10) || commitment)
UNION ALL SELECT 'link', c.lsn FROM t c JOIN t p ON c.lsn = p.lsn + 1 AND c.block = p.block AND c.prev_hash <> p.entry_hash
UNION ALL SELECT 'gap', lsn FROM t c WHERE lsn > 1 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.lsn = c.lsn - 1)"""


@query("op_v2_verify_log", oracle("chained", _TAMPER).replace("\n\n, t AS", ",\nt AS"))
def verify_log(spark, sf_dir):
    """OP-V2: a chain with some hashes altered and some entries gone: the entry does not fit, nor the next one's link, or it leaves a gap."""
    chain = I.chain(report_log(spark, sf_dir)).where("lsn % 3000 <> 7")
    bad = chain.withColumn("entry_hash", F.when(F.col("lsn") % 2000 == 200, F.sha2(F.lit("x"), 256)).otherwise(F.col("entry_hash")))
    return I.verify(cut(bad)).select("problem", "lsn")


@query("op_v4_anchor", oracle("chained", """
SELECT name, CASE WHEN a.lsn > (SELECT max(lsn) FROM log) THEN 'anchor_ahead_of_head' WHEN c.entry_hash = a.h THEN 'on_chain' ELSE 'anchor_mismatch' END AS outcome
FROM (SELECT 'exported' AS name, lsn, entry_hash AS h FROM chained WHERE lsn = 300 UNION ALL SELECT 'forged', 301, sha256('forged') UNION ALL SELECT 'ahead', 1000000000, sha256('forged')) a LEFT JOIN chained c ON c.lsn = a.lsn"""))
def anchor(spark, sf_dir):
    """OP-V4: a head exported when the log had 300 entries, a forged one and one ahead of the log, against the chain of today."""
    made = I.chain(report_log(spark, sf_dir, 300)).where("lsn = 300").select(F.lit("exported").alias("name"), "lsn", "entry_hash")
    fake = spark.range(1).select(F.explode(F.expr("array(named_struct('name', 'forged', 'lsn', 301L), named_struct('name', 'ahead', 'lsn', 1000000000L))")).alias("x")).select("x.name", "x.lsn", F.sha2(F.lit("forged"), 256).alias("entry_hash"))
    return I.check_anchors(made.unionByName(fake), cut(I.chain(report_log(spark, sf_dir))))


@query("op_e5_blocking", """
WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, string_split(name, ' ') AS t FROM n),
k AS (SELECT DISTINCT name, unnest(list_concat(list_transform(t, lambda x: 't:' || x), list_concat(list_transform(t, lambda x: 'p:' || substr(x, 1, 3)), ['i:' || array_to_string(list_transform(t, lambda x: substr(x, 1, 1)), '')]))) AS key FROM t)
SELECT key, count(*) AS names FROM k GROUP BY 1""")
def blocking(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return E.blocks(names).groupBy("key").agg(F.count(F.lit(1)).alias("names"))


@query("op_e6_merge_proposals")
def merge_proposals(spark, sf_dir):
    """OP-E1 to OP-E7: proposals among part names (alignment is an Arrow function)."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    return E.propose(names)


cte("merges", "log", "SELECT 'e' || (k % 20) AS alias, 'e' || (k % 20 // 2) AS into_, max(lsn) AS lsn FROM log WHERE k % 20 > 0 GROUP BY 1, 2")


@query("op_e10_classes", oracle("merges", """
SELECT alias, list_last(path) AS rep FROM (WITH RECURSIVE r AS (SELECT alias, into_ AS at, [into_] AS path, 1 AS n FROM merges UNION ALL SELECT r.alias, m.into_, list_append(r.path, m.into_), n + 1 FROM r JOIN merges m ON m.alias = r.at)
  SELECT alias, arg_max(path, n) AS path FROM r GROUP BY 1)""").replace("list_last(path)", "path[len(path)]"))
def classes(spark, sf_dir):
    """OP-E9, OP-E10: representative of each alias along directed merge edges."""
    log = report_log(spark, sf_dir).where("k % 20 > 0")
    m = log.select(F.concat(F.lit("e"), (F.col("k") % 20).cast("string")).alias("alias"), F.concat(F.lit("e"), F.floor(F.col("k") % 20 / 2).cast("string")).alias("into")).distinct()
    return E.representatives(m)


@query("op_e12_aggregated_evidence", oracle("direct", "SELECT split_part(entity, '-', 1) AS rep, attr, count(*) AS reports, count(DISTINCT entity) AS members FROM direct GROUP BY 1, 2"))
def aggregated(spark, sf_dir):
    """OP-E12: the evidence of all members under their representative (the buckets of a user are one entity)."""
    d = evidence(spark, sf_dir)
    return d.groupBy(F.split_part("entity", F.lit("-"), F.lit(1)).alias("rep"), "attr").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("entity").alias("members"))


@query("op_e16_entity_counts", oracle("log", "SELECT entity, count(*) AS reports FROM log GROUP BY 1"))
def entity_counts(spark, sf_dir):
    return report_log(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("reports"))


@query("op_x1_claims", """
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'unexpected_field' WHEN k % 7 = 0 THEN 'missing_span' WHEN k % 11 = 0 THEN 'unsupported_span' END AS rejected FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events)""")
def claims(spark, sf_dir):
    """OP-X1: strict decoding of claims, with typed reasons of rejection."""
    return S.decode_claims(S.claim_fixture(table(spark, sf_dir, "events"))).select("event_id", "rejected")


@query("op_x2_build_reports", oracle("log", """
SELECT CASE WHEN cue IN ('withdraw', 'dispute') THEN 'cue_not_permitted' WHEN k % 10 = 4 THEN 'undeclared_attr' WHEN k % 13 = 0 AND form IS NOT NULL AND attr <> 'tags' THEN 'form_mismatch' WHEN cue IN ('correct', 'allege') AND target < 0 THEN 'target_unresolved' ELSE 'report' END AS outcome, count(*) AS n FROM log GROUP BY 1"""))
def build_reports(spark, sf_dir):
    """OP-X2, OP-X3, OP-X6: typed claims to reports, or the first reason against."""
    return T.build_reports(report_log(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("op_x7_cost_ledger", oracle("log", """
SELECT lsn FROM (SELECT lsn, sum(k) OVER (PARTITION BY source_id ORDER BY lsn) AS spent FROM log) WHERE spent <= 500"""))
def cost_ledger(spark, sf_dir):
    """OP-X7: calls authorised while the running cost of their source stays within its cap."""
    w = Window.partitionBy("source_id").orderBy("lsn")
    return report_log(spark, sf_dir).withColumn("spent", F.sum("k").over(w)).where("spent <= 500").select("lsn")


@query("op_h6_proposals", oracle("log", "SELECT entity, arg_max(CASE k % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' ELSE 'refused' END, lsn) AS state FROM log GROUP BY 1"))
def proposals(spark, sf_dir):
    """OP-H6: the latest state of an event-sourced queue."""
    m = F.col("k") % 3
    return report_log(spark, sf_dir).groupBy("entity").agg(F.max_by(F.when(m == 0, "pending").when(m == 1, "accepted").otherwise("refused"), "lsn").alias("state"))


@query("op_h7_answer_text", oracle("sthere", "SELECT entity || '/' || attr || ': ' || status || coalesce(' (' || candidates || ')', '') AS text FROM sthere"))
def answer_text(spark, sf_dir):
    s = K.status_at(K.interpretations(evidence(spark, sf_dir)), DAY)
    return s.select(F.concat("entity", F.lit("/"), "attr", F.lit(": "), "status", F.coalesce(F.concat(F.lit(" ("), "candidates", F.lit(")")), F.lit(""))).alias("text"))


@query("op_a18_incremental", oracle("sthere keyn", "SELECT s.entity, s.attr, CAST(k.n AS INT) AS n, s.status, s.candidates FROM sthere s JOIN keyn k USING (entity, attr)"))
def incremental(spark, sf_dir):
    """OP-A18, OP-R1, OP-R2, OP-R4: the flagship answer maintained by a stream of micro-batches."""
    from attesta.streaming.maintain import incremental_status

    return incremental_status(spark, sf_dir, DAY)
