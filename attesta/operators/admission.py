"""Admission: which reports are evidence, who may act on which, what is withdrawn, what is confirmed.

All of it is joins and expressions over the log. The authority rules are configuration: they compile into one ``CASE`` chain, so checking
them needs no join. Withdrawal under live actors is the only recursion; see ``acting``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.tables import apart, cut, drop
from attesta.sources.report_log import EVIDENCE, TOLD

AGENT_CLASS = ("agent_hypothesis", "agent_statement", "plan", "simulation", "counterfactual")
ACTING = ("external_observation", *AGENT_CLASS)


@dataclass(frozen=True)
class Rule:
    """One grant. ``who``: principal, any, origin_group, target_source, target_actor or target_origin_group."""

    who: str
    may: tuple[str, ...]
    value: str | None = None
    attr: str = "*"
    entity: str = "*"
    targets: str = "report"
    over_origins: tuple[str, ...] | None = None


RULES = (
    Rule("target_source", ("correct", "withdraw"), over_origins=("external_observation",)),
    Rule("principal", ("dispute", "withdraw"), value="connector:s2", entity="u3*", targets="source"),
    Rule("any", ("dispute",), attr="emp*"),
    Rule("origin_group", ("correct",), value="g1", attr="tags", entity="u1*"),
    Rule("principal", ("withdraw",), value="agent:planner", over_origins=("agent_statement",)),
)
CLASS_STATUS = {"quarantined": "quarantined", "blocked": "blocked"}
SOURCE_STATUS: dict[str, str] = {}


def glob(pattern: str) -> str:
    """Anchored regular expression of a shell pattern with ``*`` and ``?``."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in pattern)
    return f"^{out}$"


def status_of(source_id: Column, source_class: Column, classes=CLASS_STATUS, sources=SOURCE_STATUS) -> Column:
    """Admission status of a source: its own, else that of its class, else normal."""
    out = F.lit("normal")
    for k, v in classes.items():
        out = F.when(source_class == k, v).otherwise(out)
    for k, v in sources.items():
        out = F.when(source_id == k, v).otherwise(out)
    return out


def authority(power: Column, rules=RULES) -> Column:
    """Struct (allowed, reason, ord, targets) of the first rule that lets the report's actor use ``power`` on its target. Reads
    the report's columns and those of its target with prefix ``t_``."""
    agent = F.col("actor").startswith("agent:")
    chain = None
    for i, r in enumerate(rules):
        who = {
            "principal": F.col("actor") == (r.value or ""),
            "any": ~agent,
            "origin_group": F.col("grp") == (r.value or ""),
            "target_source": F.col("source_id") == F.col("t_source_id"),
            "target_actor": F.col("actor") == F.col("t_actor"),
            "target_origin_group": F.col("grp") == F.col("t_grp"),
        }[r.who]
        fits = power.isin(*r.may) & who
        if r.who != "principal":
            fits &= ~(agent & (power == "dispute"))  # an agent disputes only by a grant to its name
        if r.attr != "*":
            fits &= F.col("t_attr").rlike(glob(r.attr))
        if r.entity != "*":
            fits &= F.col("t_entity").rlike(glob(r.entity))
        if r.over_origins is not None:
            fits &= F.col("t_origin").isin(*r.over_origins)
        if r.targets != "report":
            fits &= ~agent
        got = F.struct(F.lit(True).alias("allowed"), F.lit("rule").alias("reason"), F.lit(i).alias("ord"), F.lit(r.targets).alias("targets"))
        chain = F.when(fits, got) if chain is None else chain.when(fits, got)

    def deny(why: str) -> Column:
        return F.struct(F.lit(False).alias("allowed"), F.lit(why).alias("reason"), F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("targets"))

    never = agent & power.isin("withdraw", "correct") & ~F.col("t_origin").isin(*AGENT_CLASS)
    return F.when(never, deny("agent_invariant")).otherwise(chain.otherwise(deny("no_matching_rule")) if chain is not None else deny("no_matching_rule"))


def with_target(log: DataFrame) -> DataFrame:
    """The log with columns ``t_...`` of each report's target, null unless it comes earlier. Reports without a target, which are most,
    take a position of their own into the join that no report has, so they do not meet in one task."""
    told = ("entity", "attr", *TOLD)
    log = log.drop("t_lsn", *[f"t_{c}" for c in told])
    t = apart(log.select(F.col("lsn").alias("t_lsn"), *[F.col(c).alias(f"t_{c}") for c in told]))
    at = F.when(F.col("target").between(1, F.col("lsn") - 1), F.col("target")).otherwise(-F.col("lsn") - 2)
    return log.withColumn("target_at", at).join(t, F.col("target_at") == F.col("t_lsn"), "left").drop("target_at")


def own_merit(log: DataFrame, rules=RULES, failed_correction_allege: bool = True) -> DataFrame:
    """The decision on each report by itself: status, outcome, reason, effective_cue, auth, withdraws (lsn), wsource. Targets are looked up
    unless the log comes with them."""
    d = (log if "t_lsn" in log.columns else with_target(log)).withColumn("status", status_of(F.col("source_id"), F.col("source_class")))
    cue, status, origin = F.col("cue"), F.col("status"), F.col("origin")
    evidence_outcome = F.when(~origin.isin("external_observation", "attributed"), "excluded").when(status == "quarantined", "quarantined").otherwise("admissible")
    evidence_reason = F.when(~origin.isin("external_observation", "attributed"), "origin_not_admissible").when(status == "quarantined", "source_quarantined").otherwise("admitted")
    asked = (cue == "correct") & (status == "normal") & origin.isin(*ACTING) | cue.isin("withdraw", "dispute") & (status == "normal") & origin.isin(*ACTING)
    d = d.withColumn("auth", F.when(asked & F.col("t_lsn").isNotNull(), authority(cue, rules)))
    allowed = F.coalesce(F.col("auth.allowed"), F.lit(False))
    missing = F.col("t_lsn").isNull()

    def by(blocked, evid, miss, allege, correct, quar, orig, fail, adm) -> Column:
        return (
            F.when(status == "blocked", blocked).when(cue.isin("assert", "change"), evid).when(missing, miss).when(cue == "allege", allege)
            .when(cue == "correct", correct).when(status == "quarantined", quar).when(~origin.isin(*ACTING), orig).when(~allowed, fail).otherwise(adm)
        )

    lit = F.lit
    corrected = F.when(allowed, "correct").otherwise("allege") if failed_correction_allege else lit("correct")
    acts = (status != "blocked") & ~missing & allowed & cue.isin("correct", "withdraw")
    return d.withColumns({
        "outcome": by(lit("excluded"), evidence_outcome, lit("excluded"), lit("excluded"), evidence_outcome, lit("quarantined"), lit("excluded"), lit("excluded"), lit("admissible")),
        "reason": by(lit("source_blocked"), evidence_reason, lit("target_missing"), lit("authority_failed"), evidence_reason, lit("source_quarantined"), lit("origin_not_admissible"), lit("authority_failed"), lit("admitted")),
        "effective_cue": by(cue, cue, lit("allege"), lit("allege"), corrected, cue, cue, lit("allege"), cue),
        "withdraws": F.when(acts, F.col("target")),
        "wsource": F.when(acts & (cue == "withdraw") & (F.col("auth.targets") == "source"), F.col("t_source_id")),
    })


def claims(base: DataFrame) -> DataFrame:
    """by (lsn of the actor), claimed (lsn) and kind of what an authorised actor would withdraw by name."""
    act = base.where(F.col("withdraws").isNotNull())
    return act.select(F.col("lsn").alias("by"), F.col("withdraws").alias("claimed"), F.when(F.col("cue") == "correct", "self_correction").otherwise("withdraw").alias("kind"))


def wide_claims(base: DataFrame) -> DataFrame:
    """by, source_id: the actors that would withdraw all reports of a source. They are kept as such: never a row for each report."""
    return base.where(F.col("wsource").isNotNull()).select(F.col("lsn").alias("by"), F.col("wsource").alias("source_id"))


def acting(base: DataFrame, claim: DataFrame, wide: DataFrame) -> DataFrame:
    """lsn of the actors that act: those no later acting actor claims, by name or with their source. Starting from all actors, the
    set without a claimant in the set is taken again and again; it is final once it does not change, after as many rounds as the longest
    chain of claims. Claims on reports that do not act are left out first, so the rounds work on a small part of the log."""
    actors = base.where(F.col("withdraws").isNotNull()).select("lsn", "source_id")
    on = cut(claim.where(F.col("by") > F.col("claimed")).join(apart(actors.select(F.col("lsn").alias("claimed"))), "claimed", "left_semi").select("by", "claimed").distinct())

    some_wide = wide.limit(1).count() > 0

    def step(now: DataFrame) -> DataFrame:
        here = apart(now.select(F.col("lsn").alias("by")))
        hit = apart(on.join(here, "by", "left_semi").select(F.col("claimed").alias("lsn")))
        if not some_wide:
            return actors.join(hit, "lsn", "left_anti")
        last = wide.join(here, "by", "left_semi").groupBy("source_id").agg(F.max("by").alias("last"))
        left = actors.join(last, "source_id", "left").where(F.col("last").isNull() | (F.col("lsn") >= F.col("last")))
        return left.select("lsn", "source_id").join(hit, "lsn", "left_anti")

    now, before = actors, None
    while True:
        # two steps a round: claims only point back, so a set that two steps leave alone is the one set that one step leaves alone
        new = cut(step(step(now)))
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lsn").cast("decimal(38,0)"))).first()
        if now is not actors:
            drop(now)
        now = new
        if state == before:
            return now.select("lsn")
        before = state


def _withdrawals(base: DataFrame, must_be_live: bool) -> tuple[DataFrame, DataFrame | None, Callable]:
    """The withdrawals by name (lsn, w), those of whole sources (source_id, s; none: null), and which of w and s counts. The latest
    acting claimant does (the earliest, if actors need not live), its explicit claim before its source-wide one."""
    # narrow, a part of the log, and read in every round
    acts = cut(base.where(F.col("withdraws").isNotNull()).select("lsn", "source_id", "cue", "withdraws", "wsource"))
    claim, wide = claims(acts), wide_claims(acts)
    if must_be_live:
        live = apart(acting(acts, claim, wide).select(F.col("lsn").alias("by")))
        claim, wide = claim.join(live, "by", "left_semi"), wide.join(live, "by", "left_semi")
        best, pick = F.max, F.greatest
    else:
        best, pick = F.min, F.least
    rank = F.lit(1 if must_be_live else 0)  # an explicit claim goes first among those of one actor
    named = claim.groupBy(F.col("claimed").alias("lsn")).agg(best(F.struct("by", rank.alias("rank"), "kind")).alias("w"))
    if not acts.where("wsource is not null").limit(1).count():
        return named, None, pick
    # one row a source, of the few that have been withdrawn
    last = wide.groupBy("source_id").agg(best(F.struct("by", (1 - rank).alias("rank"), F.lit("source_withdraw").alias("kind"))).alias("s"))
    return named, last, pick


def marked(base: DataFrame, must_be_live: bool = True, of: DataFrame | None = None) -> DataFrame:
    """``base`` (or its rows ``of``) with by and kind of the withdrawal of each report, null for none."""
    return _mark(base if of is None else of, *_withdrawals(base, must_be_live))


def _mark(rows: DataFrame, named: DataFrame, last: DataFrame | None, pick: Callable) -> DataFrame:
    met = rows.join(apart(named), "lsn", "left")
    if last is not None:
        met = met.join(last, "source_id", "left").withColumn("w", pick("w", "s")).drop("s")
    return met.withColumns({"by": F.col("w.by"), "kind": F.col("w.kind")}).drop("w")


def withdrawn(base: DataFrame, must_be_live: bool = True) -> DataFrame:
    """lsn, by, kind of every withdrawn report."""
    return marked(base, must_be_live, base.select("lsn", "source_id")).where("by is not null").select("lsn", "by", "kind")


def signature(form: Column, value: Column, holder: Column) -> Column:
    """Propositions are equivalent if their signatures are equal (values are normalised when they enter the log)."""
    return F.concat_ws("|", form, holder, value)


def _confirming(all_: DataFrame) -> DataFrame:
    evid = F.col("cue").isin(*EVIDENCE)
    return all_.where((F.col("outcome") == "admissible") & (F.col("reason") == "admitted") & F.col("by").isNull() & evid)


def evaluate(log: DataFrame, rules=RULES, must_be_live: bool = True) -> DataFrame:
    """The log with its final decisions: outcome and reason after confirmation, confirmer (the first one's id), by and kind of the
    withdrawal. A quarantined report is confirmed by one of another origin group that says the same of the key; the first
    reports of two groups are all that need be known of those that could."""
    # read by every step below: else each would make the log again
    base = own_merit(log, rules).withColumn("sig", signature(F.col("form"), F.col("value"), F.col("holder")))
    base = cut(base.drop("auth", "t_entity", "t_attr", *[f"t_{c}" for c in TOLD]))
    all_ = marked(base, must_be_live)
    said = ["entity", "attr", "sig"]
    first = _confirming(all_).groupBy(*said, F.col("grp").alias("c_grp")).agg(F.min("rid").alias("c_rid"))
    at = F.row_number().over(Window.partitionBy(*said).orderBy("c_rid"))
    two = first.withColumn("at", at).where("at <= 2").groupBy(*said).agg(F.array_sort(F.collect_list(F.struct("c_rid", "c_grp"))).alias("two"))
    wait = (F.col("outcome") == "quarantined") & F.col("cue").isin(*EVIDENCE) & F.col("form").isNotNull()
    conf = base.where(wait).select("lsn", *said, "grp").join(apart(two), said)
    conf = conf.select("lsn", F.get(F.filter("two", lambda x: x["c_grp"] != F.col("grp")), F.lit(0))["c_rid"].alias("confirmer")).where("confirmer is not null")
    out = all_.join(apart(conf), "lsn", "left")
    yes = F.col("confirmer").isNotNull()
    return out.withColumns({"outcome": F.when(yes, "admissible").otherwise(F.col("outcome")), "reason": F.when(yes, "confirmed").otherwise(F.col("reason"))})


def confirmations(ev: DataFrame) -> DataFrame:
    """rid, reason, confirmed_by (all ids, sorted) of the confirmed reports. The ids are put together once for each group that waits."""
    said = ["entity", "attr", "sig"]
    wait = ev.where("reason = 'confirmed'")
    by = _confirming(ev).groupBy(*said, F.col("grp").alias("c_grp")).agg(F.collect_list("rid").alias("ids"))
    met = wait.select(*said, "grp").distinct().join(apart(by), said).where("grp <> c_grp")
    ids = met.groupBy(*said, "grp").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("confirmed_by"))
    return wait.select("rid", "reason", *said, "grp").join(apart(ids), [*said, "grp"]).select("rid", "reason", "confirmed_by")


def may_be_wide(rows: DataFrame, rules=RULES) -> DataFrame:
    """The reports that could withdraw a whole source, by what each says alone."""
    own = [r for r in rules if r.targets == "source" and "withdraw" in r.may]
    if not own:
        return rows.limit(0)
    actors = [r.value for r in own if r.who == "principal"]
    fits = F.lit(True) if len(actors) < len(own) else F.col("actor").isin(*actors)
    return rows.where((F.col("cue") == "withdraw") & fits)


def affected(rows: DataFrame, new: DataFrame, rules=RULES) -> DataFrame:
    """entity, attr, own: the keys whose decisions the reports ``new`` of the log ``rows`` can change (own), and those that have to be read to
    decide them. Reports act on their own key alone, but for source-wide withdrawals: their keys are always read, and where one of
    them is among the keys of ``new``, all keys with a report of a source that may be withdrawn change."""
    key = ["entity", "attr"]
    touched = cut(new.select(*key).distinct())
    wide = cut(may_be_wide(rows, rules).select(*key).distinct())
    if touched.join(apart(wide), key, "left_semi").limit(1).count():
        # the sources of the keys in which such reports stand hold those of their targets
        sources = rows.join(apart(wide), key, "left_semi").select("source_id").distinct()
        touched = cut(touched.unionByName(rows.join(sources, "source_id", "left_semi").select(*key)).distinct())
    return touched.withColumn("own", F.lit(True)).unionByName(wide.join(apart(touched), key, "left_anti").withColumn("own", F.lit(False)))


def update(before: DataFrame, log: DataFrame, since: int, rules=RULES) -> DataFrame:
    """``evaluate(log)`` out of ``before``, the decisions on its prefix up to ``since``: only affected keys are decided again."""
    key = ["entity", "attr"]
    keys = cut(affected(log, log.where(F.col("lsn") > since), rules))
    own = apart(keys.where("own").select(*key))
    again = evaluate(log.join(apart(keys.select(*key)), key, "left_semi"), rules).join(own, key, "left_semi")
    return before.join(own, key, "left_anti").unionByName(again)


def direct(ev: DataFrame) -> DataFrame:
    """The evidence the kernel reads: entity, attr, lsn, rid, anchor, value, op (none, change, correction), frm, of, grp, source_class."""
    d = ev.where(
        (F.col("outcome") == "admissible") & F.col("by").isNull() & F.col("cue").isin(*EVIDENCE) & (F.col("form") != "belief_of") & (F.col("origin") == "external_observation")
    )
    corrects = (F.col("cue") == "correct") & (F.col("effective_cue") == "correct")
    return d.select(
        "entity", "attr", "lsn", "rid", "anchor", "value", F.when(F.col("cue") == "change", "change").when(corrects, "correction").otherwise("none").alias("op"),
        F.col("change_from").alias("frm"), F.when(corrects, F.col("target")).alias("of"), "grp", "source_class",
    )


def denials(ev: DataFrame) -> DataFrame:
    """rid, entity, attr, form, value, t_rid: active authorised disputes on their target's own key, read as denials of it, unless a
    report of a third origin group says the same as the target."""
    ev = cut(ev.select("lsn", "rid", "entity", "attr", "anchor", "value", "cue", "effective_cue", "outcome", "by", "form", "origin", "change_from", "target", "grp", "source_class"))
    d = direct(ev)
    act = ev.where((F.col("effective_cue") == "dispute") & (F.col("outcome") == "admissible") & F.col("by").isNull()).select("rid", "entity", "attr", "grp", "target")
    t = d.select("entity", "attr", F.col("lsn").alias("target"), F.col("rid").alias("t_rid"), F.col("value"), F.col("grp").alias("t_grp"))
    met = cut(act.join(apart(t), ["entity", "attr", "target"]))
    back = d.select("entity", "attr", "value", F.col("rid").alias("c_rid"), F.col("grp").alias("c_grp"))
    backed = met.join(apart(back), ["entity", "attr", "value"]).where((F.col("c_rid") != F.col("t_rid")) & (F.col("c_grp") != F.col("grp")) & (F.col("c_grp") != F.col("t_grp"))).select("rid")
    form = F.when(F.col("attr") == "tags", "not_member").otherwise("not_value")
    return met.join(apart(backed), "rid", "left_anti").select("rid", "entity", "attr", form.alias("form"), "value", "t_rid")


def excluded(log: DataFrame, markers: DataFrame) -> DataFrame:
    """rid, marker_lsn of the reports an exclusion holds for: the latest marker of the report's source with ``from_lsn`` at most its lsn
    decides. Markers become intervals of the log in which one of them decides, so a report meets one interval of its source."""
    w = Window.partitionBy("source_id").orderBy("from_lsn")
    last = F.max(F.struct("marker_lsn", "op")).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("m")
    step = markers.select("source_id", "from_lsn", last).distinct()
    step = step.withColumn("upto", F.lead("from_lsn").over(w)).where("m.op = 'exclude'")
    hit = log.join(step, "source_id").where((F.col("lsn") >= F.col("from_lsn")) & (F.col("upto").isNull() | (F.col("lsn") < F.col("upto"))))
    return hit.select("rid", F.col("m.marker_lsn").alias("marker_lsn"))
