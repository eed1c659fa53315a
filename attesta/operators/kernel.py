"""The kernel: which TRUE/ERR labellings of a key's reports are admissible, and what they say over valid time.

One row per key holds its reports as an array ordered by (anchor, value, lsn). A labelling is a bit mask of the TRUE
reports, so the conditions on it are bit arithmetic against masks computed once per report, and the 2^n labellings
are filtered inside the row by higher-order functions: a key never leaves its row, and the only shuffle is the one that collects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.tables import apart, cut

BUDGET = 12
ENV_CAP = 256
#: attr -> (single, changeable, competing)
SPECS = {"employer": (True, True, True), "birthplace": (True, False, True), "tags": (False, False, False)}


def _bits(cond: str) -> str:
    return f"aggregate(transform(reps, (p, j) -> if({cond}, shiftleft(1L, j), 0L)), 0L, (a, b) -> a | b)"


MASKS = f"""transform(reps, (o, i) -> named_struct(
    'B', shiftleft(1L, i),
    'D', {_bits("p.value <> o.value")},
    'C', {_bits("p.value <> o.value and not (o.op = 'change' and p.anchor < o.anchor)")},
    'K', {_bits("p.op = 'correction' and p.of <=> o.lsn")},
    'S', {_bits("p.grp = o.grp and p.anchor < o.anchor")},
    'X', {_bits("o.op = 'correction' and p.lsn <=> o.of")},
    'P', {_bits("o.op = 'change' and coalesce(p.value = o.frm, false) and p.anchor < o.anchor")},
    'A', {_bits("p.anchor = o.anchor and p.value <> o.value")}))"""


def _admissible(policy: str, relax: bool) -> str:
    """Whether mask x meets every axiom: errors explained, corrections reject, changes presuppose, accepted reports agree."""
    rivals = "o.D" if policy == "P0" else "o.C"
    own = f"and not (single and changeable and (x & o.K) = 0 and (x & o.D) <> 0 and (x & o.D & ~o.S) = 0)" if policy == "P0cSU" else ""
    before = "" if relax else "and (o.P = 0 or (x & o.P) <> 0)"
    return f"""filter(every, x -> forall(m, o -> if((x & o.B) <> 0,
        (x & o.X) = 0 {before} and (not single or ((x & o.A) = 0 and (changeable or (x & o.D) = 0))),
        ((competing and (x & {rivals}) <> 0) or (x & o.K) <> 0) {own})))"""


def _flags(df: DataFrame, specs=SPECS) -> DataFrame:
    def flag(i: int):
        out = F.lit((True, True, True)[i])
        for attr, spec in specs.items():
            out = F.when(F.col("attr") == attr, F.lit(spec[i])).otherwise(out)
        return out

    return df.withColumns({"single": flag(0), "changeable": flag(1), "competing": flag(2)})


def keys(direct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """entity, attr, reps, n: the number of reports of each key and, if they are within the budget, the reports in order. Of a key only
    ``budget + 1`` reports leave a map task (a rank limit ahead of the shuffle) and the counts are partial sums, so a key of any size costs
    no task more than others. The grouping and the join reuse that shuffle. The rows are few bytes and much work, so they are dealt out once
    more over a given number of partitions: adaptive execution would put them together by their bytes."""
    spark = direct.sparkSession
    # one more than any shuffle before it has: a repartition to the number that the join leaves would be dropped as redundant
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism) + 1
    direct = cut(direct)
    many = direct.groupBy("entity", "attr").agg(F.count(F.lit(1)).cast("int").alias("n"))
    at = F.row_number().over(Window.partitionBy("entity", "attr").orderBy("lsn"))
    few = direct.withColumn("at", at).where(F.col("at") <= budget + 1)
    rep = F.struct("anchor", "value", "lsn", "rid", "op", "frm", "of", "grp", "source_class")
    held = few.groupBy("entity", "attr").agg(F.collect_list(rep).alias("reps"))
    reps = F.when(F.col("n") <= budget, F.array_sort("reps"))
    return many.join(apart(held), ["entity", "attr"], "left").select("entity", "attr", reps.alias("reps"), "n").repartition(parts, "entity", "attr")


def interpretations(direct: DataFrame, policy: str = "P0cSU", budget: int = BUDGET, specs=SPECS) -> DataFrame:
    """entity, attr, reps, n, single, changeable, masks (admissible labellings), level (of the relaxation ladder), limited. Keys with more than
    ``budget`` reports are kept with null reps and masks: they are resource-limited, never degraded."""
    k = _flags(keys(direct, budget), specs).withColumn("m", F.expr(MASKS)).withColumn("every", F.expr(f"if(n <= {budget}, sequence(0L, shiftleft(1L, n) - 1), null)"))
    k = k.withColumn("l0", F.expr(_admissible(policy, False)))
    k = k.withColumn("l1", F.expr(f"if(size(l0) = 0, {_admissible(policy, True)}, null)"))
    k = k.withColumn("l2", F.expr(f"if(size(l1) = 0, {_admissible('P0', True)}, null)"))
    level = "case when every is null then null when size(l0) > 0 then 0 when size(l1) > 0 then 1 when size(l2) > 0 then 2 else 3 end"
    masks = "case when every is null then null when size(l0) > 0 then l0 when size(l1) > 0 then l1 when size(l2) > 0 then l2 else array(0L) end"
    # filters ask ``limited`` and not ``masks``: a predicate on masks would be pushed below the projections and evaluate them twice;
    # and arrays made here, which are never empty, go through explode_outer, since explode would infer such a predicate
    return k.withColumns({"level": F.expr(level), "masks": F.expr(masks), "limited": F.col("n") > budget}).drop("m", "every", "l0", "l1", "l2")


def _top(x: str) -> str:
    """Index of the highest set bit, -1 for none."""
    return f"if({x} = 0, -1, cast(floor(log2({x})) as int))"


def _low(x: str) -> str:
    """Index of the lowest set bit, 99 for none."""
    return f"if({x} = 0, 99, cast(floor(log2({x} & -({x}))) as int))"


def family(day: str) -> str:
    """SQL of the array of candidate worlds at ``day``: each world its values joined by '+', the empty one ''."""
    upto = _bits(f"p.anchor <= {day}")
    value = "reps[{}].value"
    single = f"""array_distinct(flatten(transform(transform(masks, x -> named_struct('u', {_top(f'(x & {upto})')}, 'w', {_low(f'(x & ~{upto})')})),
        y -> case when y.u < 0 then array('')
                  when y.w = 99 or reps[y.u].anchor = {day} then array({value.format('y.u')})
                  else array({value.format('y.u')}, {value.format('y.w')}) end)))"""
    multi = f"""array_distinct(transform(masks, x -> array_join(array_sort(array_distinct(transform(filter(
        transform(reps, (p, j) -> named_struct('v', p.value, 'in', (x & shiftleft(1L, j)) <> 0 and p.anchor <= {day})), q -> q.in), q -> q.v))), '+')))"""
    return f"if(single, {single}, {multi})"


def classify(fam: str = "fam", compat: bool = False) -> str:
    """SQL of the status of a candidate family."""
    empty = "if(single, 'unknown', 'established_empty')" if compat else "'unknown'"
    return f"case when masks is null then 'resource_limited' when forall({fam}, w -> w = '') then {empty} when size({fam}) = 1 then 'established' else 'unresolved' end"


def shown(fam: str = "fam") -> str:
    """The candidates of a family as one string, in canonical order: the empty world first."""
    return f"array_join(transform(array_sort({fam}), w -> if(w = '', '(empty)', w)), '|')"


def status_at(inter: DataFrame, day: int, compat: bool = False) -> DataFrame:
    """entity, attr, n, status, candidates of each key on one day."""
    k = inter.withColumn("fam", F.expr(family(str(day))))
    return k.select("entity", "attr", "n", F.expr(classify(compat=compat)).alias("status"), F.expr(shown()).alias("candidates"))


def pieces(inter: DataFrame) -> DataFrame:
    """One row per key and piece of valid time: lo, hi (days, null: open) and rep, a day inside."""
    cuts = "array_sort(array_distinct(flatten(transform(reps, p -> array(p.anchor, p.anchor + 1)))))"
    spans = """concat(array(named_struct('lo', cast(null as int), 'hi', cuts[0], 'rep', cuts[0] - 1)),
        transform(cuts, (c, i) -> named_struct('lo', c, 'hi', get(cuts, i + 1), 'rep', c)))"""
    k = _runs(inter.where("not limited")).withColumn("cuts", F.expr(cuts))
    return k.select("*", F.explode_outer(F.expr(spans)).alias("piece")).select("*", "piece.lo", "piece.hi", "piece.rep").drop("piece", "cuts")


def _runs(k: DataFrame) -> DataFrame:
    """Adds ``runs``: for each labelling x, the mask of the run of each report (its TRUE neighbours of the same value with no TRUE
    rival between; 0 for a report that is ERR). Runs do not depend on the day, so they are computed once per key."""
    fill = "if({0} = 0, 0L, shiftleft(1L, cast(floor(log2({0})) as int) + 1) - 1)"
    below, above = "(x & o.D & (o.B - 1))", "(x & o.D & ~(o.B - 1))"
    run = f"if((x & o.B) = 0, 0L, x & ~{fill.format(below)} & if({above} = 0, -1L, ({above} & -({above})) - 1))"
    k = k.withColumn("m", F.expr(MASKS))
    return k.withColumn("runs", F.expr(f"transform(masks, x -> named_struct('x', x, 'r', transform(m, o -> {run})))")).drop("m")


SINGLE_ENVS = """flatten(transform(transform(runs, y -> named_struct('r', y.r, 'a', y.x & upto, 'b', y.x & ~upto)),
    y -> transform(case when y.a = 0 then array(-1) when y.b = 0 then array(cast(floor(log2(y.a)) as int))
            else array(cast(floor(log2(y.a)) as int), cast(floor(log2(y.b & -y.b)) as int)) end,
        i -> if(i < 0, named_struct('world', '', 'env', 0L), named_struct('world', reps[i].value, 'env', y.r[i])))))"""
# a report after the day counts only if the last one by then does not hold on that very day
SINGLE_KEEP = """transform(runs, y -> named_struct('r', y.r, 'x', if((y.x & upto) <> 0 and reps[cast(floor(log2(y.x & upto)) as int)].anchor = rep, y.x & upto, y.x)))"""
MULTI_ENVS = """transform(transform(runs, y -> transform(y.r, (r, i) -> named_struct('in', (r & upto) <> 0, 'v', reps[i].value, 'b', shiftleft(1L, i)))),
    y -> aggregate(filter(y, q -> q.in), named_struct('vs', cast(array() as array<string>), 'env', 0L),
        (a, q) -> named_struct('vs', array_union(a.vs, array(q.v)), 'env', a.env | q.b),
        a -> named_struct('world', array_join(array_sort(a.vs), '+'), 'env', a.env)))"""
ID_LIST = "array_join(array_sort(transform(filter(transform(reps, (p, j) -> named_struct('r', p.rid, 'in', (e & shiftleft(1L, j)) <> 0)), q -> q.in), q -> q.r)), ',')"


def environments(piece: DataFrame) -> DataFrame:
    """The rows of ``pieces`` with ``dist``: each (world, env) that some labelling makes possible at ``rep``; env is the mask of the
    TRUE reports in the runs that contribute the world."""
    p = piece.withColumn("upto", F.expr(_bits("p.anchor <= rep")))
    one = SINGLE_ENVS.replace("transform(runs,", f"transform({SINGLE_KEEP},", 1)
    return p.withColumn("dist", F.expr(f"array_distinct(if(single, {one}, {MULTI_ENVS}))")).drop("upto")


def supports(piece: DataFrame, minimal: bool = True) -> DataFrame:
    """The rows of ``pieces`` with ``sup``: (world, envs) with the subset-minimal environments, each a sorted id list, ordered by
    size then ids, at most ENV_CAP."""
    p = environments(piece)
    p = p.withColumn("grouped", F.expr("transform(array_sort(array_distinct(transform(dist, d -> d.world))), w -> named_struct('world', w, 'es', array_distinct(transform(filter(dist, d -> d.world = w), d -> d.env))))"))
    least = "filter(y.es, e -> not exists(y.es, f -> f <> e and (f & e) = f))" if minimal else "y.es"
    envs = f"""transform(grouped, y -> named_struct('world', y.world, 'envs',
        slice(transform(array_sort(transform({least}, e -> named_struct('n', bit_count(e), 'ids', {ID_LIST}))), z -> z.ids), 1, {ENV_CAP})))"""
    return p.withColumn("sup", F.expr(envs)).drop("dist", "grouped")


def segments(inter: DataFrame, with_supports: bool = True) -> DataFrame:
    """entity, attr, lo, hi, status, candidates, support: maximal intervals of equal family (and supports)."""
    p = pieces(inter)
    p = supports(p) if with_supports else p.withColumn("sup", F.lit("").cast("string"))
    p = p.withColumn("fam", F.expr(family("rep")))
    text = "array_join(transform(sup, s -> concat(if(s.world = '', '(empty)', s.world), '=', array_join(s.envs, ';'))), '|')" if with_supports else "''"
    p = p.select("entity", "attr", "lo", "hi", "rep", F.expr(classify()).alias("status"), F.expr(shown()).alias("candidates"), F.expr(text).alias("support"))
    w = Window.partitionBy("entity", "attr").orderBy("rep")
    new = F.coalesce((F.lag("candidates").over(w) != F.col("candidates")) | (F.lag("support").over(w) != F.col("support")), F.lit(True))
    p = p.withColumn("island", F.sum(new.cast("int")).over(w))
    return p.groupBy("entity", "attr", "island").agg(
        F.min_by("lo", "rep").alias("lo"), F.max_by("hi", "rep").alias("hi"), F.first("status").alias("status"), F.first("candidates").alias("candidates"), F.first("support").alias("support")
    ).drop("island")
