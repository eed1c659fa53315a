"""What keeps a query in bounds as the log grows: no growing side is broadcast, steps run once, the kernel is spread out."""

import re

import pytest

from attesta import plans
from attesta.operators import admission as A
from attesta.operators import kernel as K
from attesta.operators import policy as P
from attesta.operators import tables
from attesta.sources.report_log import report_log, reports, table
from attesta.streaming import maintain as M

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(df):
    """Joins with a broadcast side, but for those with the few sources that were withdrawn."""
    return [x for x in plan(df).splitlines() if re.search("Broadcast(Hash|NestedLoop)Join", x) and not re.search(r"Join \[source_id", x)]


def test_update_broadcasts_nothing_that_grows(spark):
    log = tables.cut(report_log(spark, SF))
    updated = A.update(tables.cut(A.evaluate(log.where("lsn <= 900"))), log, 900)
    assert broadcasts(updated) == [] and broadcasts(A.evaluate(log)) == []


def test_targets_come_with_the_log(spark):
    """What the log says of the targets is what a join with itself finds."""
    log = report_log(spark, SF)
    assert "Join" not in plan(A.own_merit(log))
    cols = ["lsn", *sorted(c for c in log.columns if c.startswith("t_"))]
    joined = A.with_target(log).select(cols)
    assert len(cols) == 11 and joined.where("t_lsn is not null").count() > 50
    assert joined.exceptAll(log.select(cols)).count() == 0 and log.select(cols).exceptAll(joined).count() == 0


def test_stream_broadcasts_nothing_that_grows(spark, tmp_path, monkeypatch):
    """Over two batches, of the second of which every step meets stored versions."""
    seen, cut = [], tables.cut

    def spy(df):
        seen.extend(broadcasts(df))
        return cut(df)

    for module in (M, A, K):
        monkeypatch.setattr(module, "cut", spy)
    events = table(spark, SF, "events")
    for n in range(2):
        M.apply_batch(events.where(f"event_id >= {n * 500} and event_id < {n * 500 + 500}"), n, str(tmp_path), -717)
    assert seen == []


def test_bucket_is_that_of_the_key(spark, tmp_path):
    from pyspark.sql import functions as F

    M.apply_batch(table(spark, SF, "events"), 0, str(tmp_path), -717)
    stored = spark.read.parquet(str(tmp_path / "log"))
    want = reports(stored).select("lsn", F.pmod(F.xxhash64("entity", "attr"), F.lit(M.BUCKETS)).alias("want"))
    assert stored.join(want, stored["event_id"] + 1 == want["lsn"]).where("bucket <> want").count() == 0 and stored.count() == table(spark, SF, "events").count()


@pytest.mark.parametrize("name", ["op_k15_last_segment", "op_k7_runs", "op_k17_changed"])
def test_kernel_keeps_its_partitions(spark, name):
    """Also where shuffles have as many partitions as the kernel asks for: then asking was in vain, and the rows came together by their bytes."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert plans.QUERIES[name](spark, SF).rdd.getNumPartitions() == 17
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_keys_broadcast_no_reports(spark):
    direct = A.direct(A.evaluate(report_log(spark, SF)))
    assert broadcasts(K.keys(direct)) == []


def test_denials_decide_once(spark):
    got = A.denials(A.evaluate(report_log(spark, SF)))
    assert broadcasts(got) == [] and "regexp" not in plan(got).lower() and "Window" not in plan(got)


def test_scores_read_their_rows_once(spark):
    rows = [("e", "a", "x", "r1", 1, "g1", "trusted"), ("e", "a", "x", "r2", 4, "g1", "low"), ("e", "a", "x", "r3", 2, None, "other"), ("e", "a", "(empty)", None, None, None, None)]
    s = P.scores(spark.createDataFrame(rows, "entity string, attr string, cand string, rid string, lsn long, grp string, source_class string"))
    assert plan(s).split("Initial Plan")[0].count("ExistingRDD") == 1
    assert {r.cand: (r.score, r.newest, r.groups) for r in s.collect()} == {"x": (round(1 / (1 + 2.718281828459045**-3.2), 9), 4, 1), "(empty)": (round(1 / (1 + 2.718281828459045**2.7), 9), -1, 0)}


@pytest.mark.parametrize("name", ["op_y4_select", "op_y7_single_origin"])
def test_supports_are_made_once(spark, name):
    got = plan(plans.QUERIES[name](spark, SF))
    assert broadcasts(plans.QUERIES[name](spark, SF)) == [] and got.count("Generate explode") <= 3


def test_answer_runs_the_kernel_once(spark):
    """A predicate on the status would be pushed below the kernel with all that the status is made of."""
    assert not [x for x in plan(plans.QUERIES["op_c1_answer_v1"](spark, SF)).splitlines() if "Filter" in x and "forall" in x]


def test_virtual_view_broadcasts_no_answers(spark):
    assert broadcasts(plans.QUERIES["op_q3_virtual_view"](spark, SF)) == []


def test_derived_environments_broadcast_head_offices_alone(spark):
    lines = broadcasts(plans.QUERIES["op_p5_derived_environments"](spark, SF))
    assert len(lines) == 1 and "Join [v#" in lines[0]
