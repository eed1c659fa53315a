"""Integrity: commitments, the hash chain and its verification.

The chain is kept in blocks of ``BLOCK`` positions: entries are chained inside a block, and the last hashes of the blocks
(heads, one row in ``BLOCK``) are chained to one another. So building it is parallel but for the heads, and the last head stands for the whole log.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64
BLOCK = 1024


def commitment() -> Column:
    """Salted hash of a report's content (the salt is its position here; a real store draws it)."""
    return F.sha2(F.concat(F.lit("salt"), F.concat_ws("|", F.col("lsn").cast("string"), "entity", "attr", "cue", F.coalesce("value", F.lit("")))), 256)


def entry_hash(prev: Column, lsn: Column, commit: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit("log.v1"), prev, lsn.cast("string"), commit), 256)


def block_of(lsn: Column) -> Column:
    return F.floor((lsn - 1) / BLOCK)


def chain(log: DataFrame) -> DataFrame:
    """lsn, commitment, prev_hash, entry_hash. Each hash needs the one before it in its block; only (lsn, commitment) is shuffled."""

    def link(batches):
        block, prev = None, GENESIS
        for pdf in batches:
            before, after = [], []
            for lsn, commit in zip(pdf["lsn"], pdf["commitment"], strict=True):
                if (lsn - 1) // BLOCK != block:
                    block, prev = (lsn - 1) // BLOCK, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"log.v1\n{prev}\n{lsn}\n{commit}".encode()).hexdigest()
                after.append(prev)
            yield pdf.assign(prev_hash=before, entry_hash=after)

    rows = log.select("lsn", commitment().alias("commitment")).repartition(block_of(F.col("lsn"))).sortWithinPartitions("lsn")
    return rows.mapInPandas(link, "lsn long, commitment string, prev_hash string, entry_hash string")


def heads(chained: DataFrame) -> DataFrame:
    """block, last_hash, head: the chained heads, in one ordered task of one row a block."""

    def link(batches):
        prev = GENESIS
        for pdf in batches:
            out = []
            for block, last in zip(pdf["block"], pdf["last_hash"], strict=True):
                prev = hashlib.sha256(f"block.v1\n{prev}\n{block}\n{last}".encode()).hexdigest()
                out.append(prev)
            yield pdf.assign(head=out)

    last = chained.groupBy(block_of(F.col("lsn")).alias("block")).agg(F.max_by("entry_hash", "lsn").alias("last_hash"))
    return last.repartition(1).sortWithinPartitions("block").mapInPandas(link, "block long, last_hash string, head string")


def verify(chained: DataFrame) -> DataFrame:
    """lsn, problem: entries whose hash does not fit their content, links that do not fit the entry before, gaps. Row by row and by one
    equi-join on neighbouring positions; nothing is sequential."""
    own = chained.where(entry_hash(F.col("prev_hash"), F.col("lsn"), F.col("commitment")) != F.col("entry_hash")).select("lsn", F.lit("entry_hash").alias("problem"))
    before = chained.select((F.col("lsn") + 1).alias("lsn"), F.col("entry_hash").alias("want"))
    first = (F.col("lsn") - 1) % BLOCK == 0
    met = chained.join(before, "lsn", "left").withColumn("link", F.when(first, F.lit(GENESIS)).otherwise(F.col("want")))
    link = met.where("link <> prev_hash").select("lsn", F.lit("link").alias("problem"))
    gap = met.where("want is null and lsn > 1").select("lsn", F.lit("gap").alias("problem"))
    return own.unionByName(link).unionByName(gap)


def check_anchors(anchors: DataFrame, chained: DataFrame) -> DataFrame:
    """name, outcome of exported heads (name, lsn, entry_hash): on_chain, anchor_mismatch or anchor_ahead_of_head."""
    end = chained.agg(F.max("lsn").alias("end"))
    met = anchors.join(chained.select("lsn", F.col("entry_hash").alias("have")), "lsn", "left").crossJoin(F.broadcast(end))  # one row
    return met.select("name", F.when(F.col("lsn") > F.col("end"), "anchor_ahead_of_head").when(F.col("have") == F.col("entry_hash"), "on_chain").otherwise("anchor_mismatch").alias("outcome"))


def admission_hash(lsn: Column, record: Column, report_hash: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit("admission.v1"), lsn.cast("string"), record, report_hash), 256)


def verify_admissions(stored: DataFrame, chained: DataFrame) -> DataFrame:
    """lsn, problem of stored admission records (lsn, record, report_hash, entry_hash): a record changed after it was hashed, or one whose
    report is missing or not the one it was decided on."""
    own = stored.where(admission_hash(F.col("lsn"), F.col("record"), F.col("report_hash")) != F.col("entry_hash")).select("lsn", F.lit("admission_hash_mismatch").alias("problem"))
    met = stored.join(chained.select("lsn", F.col("entry_hash").alias("have")), "lsn", "left").where("have is null or have <> report_hash")
    return own.unionByName(met.select("lsn", F.lit("admission_report_mismatch").alias("problem")))


def verify_beliefs(stored: DataFrame, fresh: DataFrame, stale: DataFrame) -> DataFrame:
    """entity, attr of the keys whose stored status and candidates are not those computed again. Keys known to be stale are left out; a
    stored ``unknown`` fits a key left without evidence."""
    key = ["entity", "attr"]
    a = stored.select(*key, F.struct("status", "candidates").alias("old"))
    b = fresh.select(*key, F.struct("status", "candidates").alias("new"))
    met = a.join(b, key, "full").join(stale.select(*key), key, "left_anti")
    gone = F.col("new").isNull() & (F.col("old.status") == "unknown")
    return met.where(~F.col("old").eqNullSafe(F.col("new")) & ~F.coalesce(gone, F.lit(False))).select(*key)


@F.pandas_udf(T.StringType())
def hmac_name(name: pd.Series) -> pd.Series:
    """Pseudonym of a name under a host-held secret (a fixed one in this fixture)."""
    return name.map(lambda x: None if x is None else hmac.new(b"fixture-secret", b"key\n" + x.encode(), hashlib.sha256).hexdigest())
