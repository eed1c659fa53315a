"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots; bytes are aggregated per slot; a versioned
map says which shard holds which slot. Records never move between slots, so a rebalance edits only the map
(at most ``n_slots`` rows, whatever the data). Version 1 gives slots, heaviest first, to the lightest shard;
``rebalance`` derives the next version, in which a shard gives away no more than what is above the new even share. The map is a table, a folder for each version: ``store`` writes
the next one and leaves earlier ones alone, ``load`` reads any.

Equal texts are separate records, spread by their ids: a text that a third of all rows hold is spread over all slots. (In
the check's terms, groups of equal texts are the hot groups here; nothing keeps them together.)
Nulls: a null text has no bytes, a null id hashes as the word null. Repeated rows are separate records of one slot
(their order inside it is arbitrary but they are equal). An empty table gives an empty result and a map of empty slots.
Only id, size and checksum are shuffled, never the text; extra columns of any name are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hash32, shared_dir, table

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


def virtual_slot(doc_id: Column, n_slots: int = SLOTS) -> Column:
    return (hash32(doc_id, "slot") % n_slots).cast("int")


def records(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        virtual_slot(F.col("doc_id"), n_slots).alias("virtual_slot"),
    )


def slot_sizes(recs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included (``n_slots`` rows)."""
    sums = recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = recs.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(sizes: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: heaviest slot first, each to the shard that has the fewest bytes so far (ties: fewest
    slots, then lowest number). One row of state folds over the bounded list of slots."""
    one = sizes.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "rows"))).alias("slots"))
    start = f"transform(sequence(0, {n_shards - 1}), x -> named_struct('bytes', 0L, 'n', 0, 'shard', x))"
    put = one.selectExpr(
        f"""aggregate(slots,
            named_struct('load', {start}, 'got', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
            (acc, s) -> named_struct(
                'load', transform(acc.load, l -> if(l.shard = array_min(acc.load).shard,
                    named_struct('bytes', l.bytes - s.neg, 'n', l.n + 1, 'shard', l.shard), l)),
                'got', array_append(acc.got, named_struct('virtual_slot', s.virtual_slot, 'shard', array_min(acc.load).shard))),
            acc -> acc.got) AS got"""
    )
    return put.select(F.inline("got")).withColumn("version", F.lit(1))


def rebalance(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """Next version of the map for ``n_shards`` shards. Slots whose running bytes inside their shard go beyond the
    new even share are lifted off, smallest slots last to leave, and handed to the shards below it; all other slots stay."""
    have = slot_map.join(sizes, "virtual_slot")
    share = have.agg(F.sum("bytes").alias("total")).select((F.col("total") / n_shards).alias("share"))
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    run = have.crossJoin(F.broadcast(share)).withColumn("upto", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stay = run.where((F.col("shard") < n_shards) & ((F.col("upto") <= F.ceil("share")) | (F.col("bytes") == 0)))
    lift = run.join(stay.select("virtual_slot"), "virtual_slot", "left_anti")
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    load = shards.join(stay.groupBy("shard").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).cast("int").alias("n")), "shard", "left").na.fill(0)
    state = load.agg(F.sort_array(F.collect_list(F.struct(F.col("b").alias("bytes"), "n", "shard"))).alias("load"))
    queue = lift.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot"))).alias("slots"))
    moved = state.crossJoin(queue).selectExpr(
        """aggregate(slots,
            named_struct('load', load, 'got', cast(array() as array<struct<virtual_slot:int,shard:int>>)),
            (acc, s) -> named_struct(
                'load', transform(acc.load, l -> if(l.shard = array_min(acc.load).shard,
                    named_struct('bytes', l.bytes - s.neg, 'n', l.n + 1, 'shard', l.shard), l)),
                'got', array_append(acc.got, named_struct('virtual_slot', s.virtual_slot, 'shard', array_min(acc.load).shard))),
            acc -> acc.got) AS got"""
    ).select(F.inline("got"))
    version = slot_map.agg((F.max("version") + 1).alias("version"))
    return stay.select("virtual_slot", "shard").unionByName(moved).crossJoin(F.broadcast(version))


def store(slot_map: DataFrame, folder: str) -> DataFrame:
    """Writes the map as the folder of its version, which must be new, and returns it as read back."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.parquet(f"{folder}/version={version}")
    return load(slot_map.sparkSession, folder, version)


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """virtual_slot, shard, version of one version of a stored map, the last by default."""
    every = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    return every.where(F.col("version") == (every.agg(F.max("version")).first()[0] if version is None else version))


def place(recs: DataFrame, slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shard and gapless position inside the shard of each record: the rows of the earlier slots of the shard, then
    the row's place in its own slot. No task ever sorts more than one slot."""
    w = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    start = slot_map.join(sizes, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("start"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = recs.withColumn("at", F.row_number().over(inside))
    return ranked.join(F.broadcast(start), "virtual_slot").withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long"))


def op6_virtual_slots(spark, sf_dir):
    """The records on the shards of version 1 of a stored map; ``next_shard`` is theirs under version 2, edited for one shard more."""
    recs = records(table(spark, sf_dir, "documents"))
    sizes = cut(slot_sizes(recs))
    folder = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    first = store(first_map(sizes), folder)
    grown = store(rebalance(first, sizes, SHARDS + 1), folder)
    out = place(recs, first, sizes).join(F.broadcast(grown.select("virtual_slot", F.col("shard").alias("next_shard"))), "virtual_slot")  # SLOTS rows
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "next_shard")
