"""DuckDB SQL of the stages that the query oracles share, as named common table expressions.

They say the same as the Spark operators in another way: labellings are rows of (key, mask, report) and axioms are aggregates over
pairs of reports, runs are gaps and islands with explicit bounds, withdrawal is a fixed number of alternating anti-joins.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, ...] | str] = {}
BODY: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, needs: str, sql: str) -> None:
    NEEDS[name] = needs.split()
    BODY[name] = sql


def oracle(needs: str, select: str) -> str:
    """``select`` with the common table expressions it needs, in order of their dependence."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in done:
            done.append(name)

    for n in needs.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({BODY[n]})" for n in done) + "\n" + select


def day(ts: str) -> str:
    return f"(CAST({ts} AS DATE) - DATE '2026-01-01')"


cte("log0", "", """
SELECT event_id + 1 AS lsn, ts AS recorded_at, 'r' || lpad(CAST(event_id + 1 AS VARCHAR), 10, '0') AS rid,
       'u' || user_id || '-' || ((day(ts) - 1) // 5) AS entity, event_type, CAST(floor(value) AS INT) AS x,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events""")
cte("log1", "log0", """
SELECT lsn, recorded_at, rid, k, entity, x,
       CASE WHEN k % 10 < 6 THEN 'employer' WHEN k % 10 < 8 THEN 'birthplace' ELSE 'tags' END AS attr,
       CASE WHEN event_type = 'purchase' THEN 'change' WHEN event_type <> 'error' THEN 'assert' WHEN k % 2 = 0 THEN 'correct'
            WHEN k % 8 = 1 THEN 'dispute' WHEN k % 8 = 3 THEN 'allege' ELSE 'withdraw' END AS cue,
       's' || (k % 7) AS source_id, ['trusted', 'trusted', 'low', 'quarantined', 'standard', 'standard', 'blocked'][k % 7 + 1] AS source_class,
       CASE k WHEN 99 THEN 'agent_statement' WHEN 98 THEN 'attributed' ELSE 'external_observation' END AS origin,
       'g' || (k % 4) AS grp, CASE WHEN k = 99 THEN 'agent:planner' ELSE 'connector:s' || (k % 7) END AS actor,
       CASE WHEN k % 11 = 0 THEN recorded_at - to_days(k % 4) END AS valid_from
FROM log0""")
cte("log", "log1", f"""
SELECT * EXCLUDE (x),
       CASE WHEN cue IN ('assert', 'change', 'correct') THEN 'v' || (x % 3) END AS value,
       CASE WHEN cue IN ('assert', 'change', 'correct') THEN CASE WHEN origin = 'attributed' THEN 'belief_of' WHEN attr = 'tags' THEN 'member' ELSE 'value' END END AS form,
       CASE WHEN cue IN ('assert', 'change', 'correct') AND origin = 'attributed' THEN 'h' || (x % 2) END AS holder,
       CASE WHEN cue = 'change' AND k % 2 = 0 THEN 'v' || ((x + 1) % 3) END AS change_from,
       CAST({day('coalesce(valid_from, recorded_at)')} AS INT) AS anchor,
       CASE WHEN cue NOT IN ('assert', 'change') THEN coalesce(
           CASE WHEN k % 3 < 2 THEN lag(lsn) OVER (PARTITION BY entity, attr, source_id ORDER BY lsn) END,
           lag(lsn) OVER (PARTITION BY entity, attr ORDER BY lsn), -1) END AS target
FROM log1""")
cte("rules", "", """
SELECT * FROM (VALUES
  (0, 'target_source', NULL, ['correct', 'withdraw'], '*', '*', 'report', ['external_observation']),
  (1, 'principal', 'connector:s2', ['dispute', 'withdraw'], '*', 'u3*', 'source', NULL),
  (2, 'any', NULL, ['dispute'], 'emp*', '*', 'report', NULL),
  (3, 'origin_group', 'g1', ['correct'], 'tags', 'u1*', 'report', NULL),
  (4, 'principal', 'agent:planner', ['withdraw'], '*', '*', 'report', ['agent_statement'])) r(ord, who, who_value, may, attr_glob, entity_glob, targets, over_origins)""")
cte("pair", "log", """
SELECT l.*, t.lsn AS t_lsn, t.entity AS t_entity, t.attr AS t_attr, t.source_id AS t_source_id, t.actor AS t_actor, t.grp AS t_grp, t.origin AS t_origin, t.cue AS t_cue, t.form AS t_form, t.value AS t_value,
       CASE l.source_class WHEN 'blocked' THEN 'blocked' WHEN 'quarantined' THEN 'quarantined' ELSE 'normal' END AS status
FROM log l LEFT JOIN log t ON l.target = t.lsn AND t.lsn < l.lsn""")
cte("granted", "pair rules", """
SELECT p.lsn, min(r.ord) AS ord, arg_min(r.targets, r.ord) AS targets
FROM pair p JOIN rules r ON list_contains(r.may, p.cue) AND p.t_attr GLOB r.attr_glob AND p.t_entity GLOB r.entity_glob
 AND (r.over_origins IS NULL OR list_contains(r.over_origins, p.t_origin))
 AND CASE r.who WHEN 'principal' THEN p.actor = r.who_value
     ELSE NOT (p.actor LIKE 'agent:%' AND p.cue = 'dispute') AND CASE r.who WHEN 'any' THEN p.actor NOT LIKE 'agent:%'
       WHEN 'origin_group' THEN p.grp = r.who_value WHEN 'target_source' THEN p.source_id = p.t_source_id
       WHEN 'target_actor' THEN p.actor = p.t_actor ELSE p.grp = p.t_grp END END
 AND (r.targets = 'report' OR p.actor NOT LIKE 'agent:%')
WHERE p.t_lsn IS NOT NULL AND p.status = 'normal' AND p.cue IN ('correct', 'withdraw', 'dispute')
  AND p.origin IN ('external_observation', 'agent_hypothesis', 'agent_statement', 'plan', 'simulation', 'counterfactual')
  AND NOT (p.actor LIKE 'agent:%' AND p.cue IN ('withdraw', 'correct') AND p.t_origin NOT IN ('agent_hypothesis', 'agent_statement', 'plan', 'simulation', 'counterfactual'))
GROUP BY p.lsn""")
cte("base", "pair granted", """
SELECT p.*, g.ord, g.targets AS extent, g.ord IS NOT NULL AS allowed,
  CASE WHEN status = 'blocked' THEN 'excluded:source_blocked'
       WHEN cue NOT IN ('assert', 'change') AND t_lsn IS NULL THEN 'excluded:target_missing'
       WHEN cue = 'allege' THEN 'excluded:authority_failed'
       WHEN cue IN ('assert', 'change', 'correct') THEN
         CASE WHEN origin NOT IN ('external_observation', 'attributed') THEN 'excluded:origin_not_admissible'
              WHEN status = 'quarantined' THEN 'quarantined:source_quarantined' ELSE 'admissible:admitted' END
       WHEN status = 'quarantined' THEN 'quarantined:source_quarantined'
       WHEN origin = 'attributed' THEN 'excluded:origin_not_admissible'
       WHEN g.ord IS NULL THEN 'excluded:authority_failed' ELSE 'admissible:admitted' END AS verdict,
  CASE WHEN status = 'blocked' OR cue IN ('assert', 'change') THEN cue WHEN t_lsn IS NULL THEN 'allege'
       WHEN cue = 'correct' THEN CASE WHEN g.ord IS NULL THEN 'allege' ELSE 'correct' END
       WHEN cue = 'allege' THEN 'allege' WHEN status = 'quarantined' OR origin = 'attributed' THEN cue
       WHEN g.ord IS NULL THEN 'allege' ELSE cue END AS effective_cue
FROM pair p LEFT JOIN granted g USING (lsn)""")
cte("claims", "base", """
SELECT lsn AS by_lsn, target AS claimed, CASE cue WHEN 'correct' THEN 'self_correction' ELSE 'withdraw' END AS kind, true AS explicit
FROM base WHERE allowed AND cue IN ('correct', 'withdraw') AND status = 'normal'
UNION ALL
SELECT b.lsn, e.lsn, 'source_withdraw', false FROM base b JOIN base e ON e.source_id = b.t_source_id
WHERE b.allowed AND b.cue = 'withdraw' AND b.extent = 'source' AND b.status = 'normal'""")
cte("act0", "claims", "SELECT DISTINCT by_lsn FROM claims")
for _i in range(1, 13):
    cte(f"act{_i}", f"act{_i - 1} act0 claims", f"SELECT by_lsn FROM act0 a WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.claimed = a.by_lsn AND c.by_lsn > c.claimed AND c.by_lsn IN (SELECT by_lsn FROM act{_i - 1}))")
cte("gone", "claims act12", """
SELECT claimed AS lsn, arg_max(by_lsn, by_lsn * 2 + explicit::INT) AS by_lsn, arg_max(kind, by_lsn * 2 + explicit::INT) AS kind
FROM claims WHERE by_lsn IN (SELECT by_lsn FROM act12) GROUP BY claimed""")
cte("conf", "base gone", """
SELECT q.lsn, string_agg(c.rid, ',' ORDER BY c.rid) AS confirmed_by
FROM base q JOIN base c ON c.entity = q.entity AND c.attr = q.attr AND c.form = q.form AND c.value = q.value AND c.holder IS NOT DISTINCT FROM q.holder AND c.grp <> q.grp
WHERE q.verdict LIKE 'quarantined%' AND q.form IS NOT NULL AND c.verdict = 'admissible:admitted' AND c.cue IN ('assert', 'change', 'correct') AND c.lsn NOT IN (SELECT lsn FROM gone)
GROUP BY q.lsn""")
cte("ev", "base gone conf", """
SELECT b.*, CASE WHEN confirmed_by IS NOT NULL THEN 'admissible' ELSE split_part(verdict, ':', 1) END AS outcome,
       CASE WHEN confirmed_by IS NOT NULL THEN 'confirmed' ELSE split_part(verdict, ':', 2) END AS reason, confirmed_by, gone.by_lsn, gone.kind
FROM base b LEFT JOIN gone USING (lsn) LEFT JOIN conf USING (lsn)""")
cte("direct", "ev", """
SELECT entity, attr, lsn, rid, anchor, value, CASE WHEN cue = 'change' THEN 'change' WHEN cue = 'correct' AND effective_cue = 'correct' THEN 'correction' ELSE 'none' END AS op,
       change_from AS frm, CASE WHEN cue = 'correct' AND effective_cue = 'correct' THEN target END AS of_, grp, source_class
FROM ev WHERE outcome = 'admissible' AND by_lsn IS NULL AND cue IN ('assert', 'change', 'correct') AND form <> 'belief_of' AND origin = 'external_observation'""")
cte("obs", "direct", """
SELECT *, row_number() OVER (PARTITION BY entity, attr ORDER BY anchor, value, lsn) - 1 AS i, count(*) OVER (PARTITION BY entity, attr) AS n,
       attr <> 'tags' AS single, attr = 'employer' AS changeable, attr <> 'tags' AS competing FROM direct""")
cte("rel", "obs", """
SELECT o.entity, o.attr, o.i, p.i AS j, p.value <> o.value AS d, p.value <> o.value AND NOT (o.op = 'change' AND p.anchor < o.anchor) AS c,
       p.op = 'correction' AND p.of_ = o.lsn AS k, p.grp = o.grp AND p.anchor < o.anchor AS s, o.op = 'correction' AND o.of_ = p.lsn AS x,
       o.op = 'change' AND p.value = o.frm AND p.anchor < o.anchor AS pf, p.anchor = o.anchor AND p.value <> o.value AS a
FROM obs o JOIN obs p ON o.entity = p.entity AND o.attr = p.attr""")
cte("lab", "obs", """
SELECT o.*, m.mask, (m.mask >> o.i) & 1 = 1 AS t FROM obs o, LATERAL (SELECT unnest(range(0, 1::BIGINT << o.n::INT)) AS mask) m WHERE o.n <= 12""")
cte("chk", "lab rel", """
SELECT o.entity, o.attr, o.mask, o.i, any_value(o.t) AS t, any_value(o.single) AS single, any_value(o.changeable) AS changeable, any_value(o.competing) AS competing,
       bool_or(p.t AND r.d) AS d, bool_or(p.t AND r.c) AS c, coalesce(bool_or(p.t AND r.k), false) AS k, bool_or(p.t AND r.d AND NOT r.s) AS foreign_d,
       coalesce(bool_or(p.t AND r.x), false) AS x, coalesce(bool_or(r.pf), false) AS pf, coalesce(bool_or(p.t AND r.pf), false) AS tpf, bool_or(p.t AND r.a) AS a
FROM lab o JOIN rel r ON r.entity = o.entity AND r.attr = o.attr AND r.i = o.i
JOIN lab p ON p.entity = o.entity AND p.attr = o.attr AND p.mask = o.mask AND p.i = r.j GROUP BY 1, 2, 3, 4""")
cte("okm", "chk", """
SELECT entity, attr, mask,
  bool_and(CASE WHEN t THEN NOT x AND (NOT pf OR tpf) AND (NOT single OR (NOT a AND (changeable OR NOT d)))
           ELSE ((competing AND c) OR k) AND NOT (single AND changeable AND NOT k AND d AND NOT foreign_d) END) AS ok0,
  bool_and(CASE WHEN t THEN NOT x AND (NOT single OR (NOT a AND (changeable OR NOT d)))
           ELSE ((competing AND c) OR k) AND NOT (single AND changeable AND NOT k AND d AND NOT foreign_d) END) AS ok1,
  bool_and(CASE WHEN t THEN NOT x AND (NOT single OR (NOT a AND (changeable OR NOT d))) ELSE (competing AND d) OR k END) AS ok2
FROM chk GROUP BY 1, 2, 3""")
cte("lev", "okm", "SELECT entity, attr, CASE WHEN bool_or(ok0) THEN 0 WHEN bool_or(ok1) THEN 1 WHEN bool_or(ok2) THEN 2 ELSE 3 END AS level FROM okm GROUP BY 1, 2")
cte("interp", "okm lev", "SELECT entity, attr, mask, level FROM okm JOIN lev USING (entity, attr) WHERE CASE level WHEN 0 THEN ok0 WHEN 1 THEN ok1 WHEN 2 THEN ok2 ELSE mask = 0 END")
cte("keyn", "obs", "SELECT entity, attr, any_value(n) AS n, any_value(single) AS single FROM obs GROUP BY 1, 2")
# runs of every labelling with their four bounds
cte("tru", "interp lab", """
SELECT l.entity, l.attr, l.mask, l.i, l.value, l.anchor, l.rid, l.lsn, l.single,
       sum(CASE WHEN l.value IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY l.entity, l.attr, l.mask ORDER BY l.i) AS run
FROM (SELECT lab.*, lag(value) OVER (PARTITION BY entity, attr, mask ORDER BY i) AS prev FROM lab JOIN interp USING (entity, attr, mask) WHERE t) l""")
cte("runs", "tru", """
SELECT *, CASE WHEN nxt IS NULL OR NOT single THEN 1000000 ELSE last END AS end_lo, CASE WHEN NOT single THEN 1000000 ELSE coalesce(nxt, 1000000) END AS end_hi
FROM (SELECT entity, attr, mask, run, value, single, first, last, ids, lead(first) OVER (PARTITION BY entity, attr, mask ORDER BY run) AS nxt,
             CASE WHEN NOT single THEN first ELSE coalesce(lag(last) OVER (PARTITION BY entity, attr, mask ORDER BY run), first) END AS start_lo
      FROM (SELECT entity, attr, mask, run, any_value(value) AS value, any_value(single) AS single, min(anchor) AS first, max(anchor) AS last, list(rid ORDER BY rid) AS ids FROM tru GROUP BY 1, 2, 3, 4))""")
cte("days", "obs", "SELECT DISTINCT entity, attr, unnest([anchor, anchor + 1]) AS d FROM obs WHERE n <= 12")
cte("piece", "days", """
SELECT entity, attr, d AS lo, lead(d) OVER (PARTITION BY entity, attr ORDER BY d) AS hi, d AS rep FROM days
UNION ALL SELECT entity, attr, NULL, min(d), min(d) - 1 FROM days GROUP BY 1, 2""")
# at each day, which runs hold for sure (2) or perhaps (1)
cte("cover", "piece interp runs", """
SELECT p.entity, p.attr, p.lo, p.hi, p.rep, i.mask, r.value, r.ids, r.single,
       CASE WHEN r.run IS NULL THEN 0 WHEN p.rep < r.first THEN (r.start_lo < p.rep)::INT WHEN p.rep <= r.end_lo THEN 2 WHEN p.rep < r.end_hi THEN 1 ELSE 0 END AS cov
FROM piece p JOIN interp i USING (entity, attr) LEFT JOIN runs r ON r.entity = i.entity AND r.attr = i.attr AND r.mask = i.mask""")
_WORLD = """
SELECT {k}, mask, CASE WHEN single THEN value ELSE '' END AS world, ids FROM (
  SELECT *, max(cov) OVER (PARTITION BY {k}, mask) AS most FROM cover{s}) WHERE single AND cov > 0 AND (cov = 2 OR most = 1)
UNION ALL
SELECT {k}, mask, coalesce(string_agg(DISTINCT value, '+' ORDER BY value) FILTER (WHERE cov = 2), ''), flatten(coalesce(list(ids) FILTER (WHERE cov = 2), [])) FROM cover{s}
GROUP BY {k}, mask HAVING max(cov) = 0 OR NOT any_value(single)"""
cte("worlds", "cover", _WORLD.format(k="entity, attr, lo, hi, rep", s=""))
# for a single key the runs of the same value that cover the day are one environment
cte("wenv", "worlds", """
SELECT DISTINCT entity, attr, lo, hi, rep, world, list_sort(list_distinct(flatten(list(ids)))) AS env FROM worlds GROUP BY entity, attr, lo, hi, rep, mask, world""")
cte("minenv", "wenv", """
SELECT * FROM wenv e WHERE NOT EXISTS (SELECT 1 FROM wenv f WHERE f.entity = e.entity AND f.attr = e.attr AND f.rep = e.rep AND f.world = e.world AND len(f.env) < len(e.env) AND list_has_all(e.env, f.env))""")
cte("fam", "worlds", "SELECT DISTINCT entity, attr, lo, hi, rep, world FROM worlds")
cte("seg0", "fam", """
SELECT entity, attr, lo, hi, rep, CASE WHEN bool_and(world = '') THEN 'unknown' WHEN count(*) = 1 THEN 'established' ELSE 'unresolved' END AS status,
       string_agg(CASE WHEN world = '' THEN '(empty)' ELSE world END, '|' ORDER BY world) AS candidates FROM fam GROUP BY 1, 2, 3, 4, 5""")
cte("sup0", "minenv", """
SELECT entity, attr, rep, string_agg(CASE WHEN world = '' THEN '(empty)' ELSE world END || '=' || envs, '|' ORDER BY world) AS support
FROM (SELECT entity, attr, rep, world, string_agg(array_to_string(env, ','), ';' ORDER BY len(env), array_to_string(env, ',')) AS envs FROM minenv GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
cte("seg1", "seg0 sup0", """
SELECT s.*, sup0.support, CASE WHEN lag(s.candidates || '#' || sup0.support) OVER w IS DISTINCT FROM s.candidates || '#' || sup0.support THEN 1 ELSE 0 END AS fresh
FROM seg0 s JOIN sup0 USING (entity, attr, rep) WINDOW w AS (PARTITION BY s.entity, s.attr ORDER BY s.rep)""")
cte("seg", "seg1", """
SELECT entity, attr, arg_min(coalesce(lo, -1000000), rep) AS lo0, arg_max(coalesce(hi, 1000000), rep) AS hi0, any_value(status) AS status, any_value(candidates) AS candidates, any_value(support) AS support
FROM (SELECT *, sum(fresh) OVER (PARTITION BY entity, attr ORDER BY rep) AS island FROM seg1) GROUP BY entity, attr, island""")
cte("segment", "seg", "SELECT entity, attr, CAST(nullif(lo0, -1000000) AS INT) AS lo, CAST(nullif(hi0, 1000000) AS INT) AS hi, status, candidates, support FROM seg")
_HASH = "sha256('log.v1' || chr(10) || {0} || chr(10) || c.lsn || chr(10) || c.commitment)"
_ZERO = "repeat('0', 64)"
cte("commits", "log", "SELECT lsn, (lsn - 1) // 1024 AS block, sha256('salt' || lsn || '|' || entity || '|' || attr || '|' || cue || '|' || coalesce(value, '')) AS commitment FROM log")
cte("chained", "commits", f"""
WITH RECURSIVE r AS (
  SELECT lsn, block, commitment, {_ZERO} AS prev_hash, {_HASH.format(_ZERO)} AS entry_hash FROM commits c WHERE (lsn - 1) % 1024 = 0
  UNION ALL SELECT c.lsn, c.block, c.commitment, r.entry_hash, {_HASH.format("r.entry_hash")} FROM r JOIN commits c ON c.lsn = r.lsn + 1 AND c.block = r.block) SELECT * FROM r""")
cte("heads", "chained", f"""
WITH RECURSIVE l AS (SELECT block, arg_max(entry_hash, lsn) AS last_hash FROM chained GROUP BY 1),
h AS (SELECT block, sha256('block.v1' || chr(10) || {_ZERO} || chr(10) || block || chr(10) || last_hash) AS head FROM l WHERE block = 0
  UNION ALL SELECT l.block, sha256('block.v1' || chr(10) || h.head || chr(10) || l.block || chr(10) || l.last_hash) FROM h JOIN l ON l.block = h.block + 1) SELECT * FROM h""")
cte("gen", "log", "SELECT entity, attr, max(lsn) AS required, max(lsn) FILTER (WHERE k % 4 <> 0) AS completed, bool_or(k = 50) AS dirty, bool_or(k = 51) AS erased, arg_max(k % 9 = 0, lsn) AS incomplete FROM log GROUP BY 1, 2")
