"""The driver's contract, and queries against their oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from attesta import plans

SF = "/root/testdata/sf0.001"
SOME = ["op_a2_own_merit", "op_a10_confirmation", "op_a14_dispute_denials", "op_k6_relaxation", "op_k14_segments", "op_y5_decide", "op_s19_outbox", "op_d2_rules_per_head", "op_r10_barrier_read", "op_b4_decision_scorer"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.ORACLES) <= set(plans.QUERIES) and len(plans.QUERIES) > 120


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "supplier", "part", "labels", "conversations", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(str([r[i] for i in at]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in got.collect()) == want
