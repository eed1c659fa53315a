"""Incremental maintenance: a stream of report events kept as versioned beliefs.

Each micro-batch is appended to the stored events, which are laid out in ``BUCKETS`` folders by a hash of the key. Only the keys
that the batch can change are read, decided again and, if their direct evidence differs from that of their current version, sent through the
kernel for a new one. The batch number is the generation, and every version stays readable, so beliefs can be read as of any
of them. A batch that is replayed after a failure rewrites its own files, so effects are exactly once. No watermark is
needed: the log position orders reports, and a late report is one about an earlier day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators import admission as A
from attesta.operators import kernel as K
from attesta.operators.store import id_set
from attesta.operators.tables import apart, cut, shared_dir
from attesta.sources.report_log import attr_of, entity_of, k_of, reports, table, with_targets

BUCKETS = 32
VERSION = "entity string, attr string, ids string, n int, status string, candidates string, generation long"


def _keyed(direct: DataFrame) -> DataFrame:
    return direct.groupBy("entity", "attr").agg(id_set().cast("string").alias("ids"))


def current(versions: DataFrame) -> DataFrame:
    """The version of the greatest generation of each key."""
    cols = [F.col(c) for c in ("ids", "n", "status", "candidates")]
    return versions.groupBy("entity", "attr").agg(F.max_by(F.struct(*cols), "generation").alias("v")).select("entity", "attr", "v.*")


def read_versions(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(VERSION).option("recursiveFileLookup", "true").parquet(f"{store}/versions")


def as_of(versions: DataFrame, generation: int) -> DataFrame:
    """The version of each key in force after a batch."""
    return current(versions.where(F.col("generation") <= generation))


def apply_batch(batch: DataFrame, generation: int, store: str, day: int) -> None:
    spark, key = batch.sparkSession, ["entity", "attr"]

    def bucket(*key) -> F.Column:
        return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")

    own_key = entity_of(F.col("user_id"), F.col("ts")), attr_of(k_of(F.col("props")))
    batch.withColumn("bucket", bucket(*own_key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/log/batch={generation}")
    schema = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(f"{store}/log").where(F.col("batch") <= generation)
    keys = cut(A.affected(reports(stored), reports(batch)))
    near = [r[0] for r in keys.select(bucket(*key)).distinct().collect()]  # at most BUCKETS numbers
    rows = reports(stored.where(F.col("bucket").isin(near))).join(apart(keys.select(*key)), key, "left_semi")
    own = apart(keys.where("own").select(*key))
    direct = cut(A.direct(A.evaluate(with_targets(rows))).join(own, key, "left_semi"))
    now = own.join(apart(_keyed(direct)), key, "left")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    if old.getFileSystem(spark._jsc.hadoopConfiguration()).exists(old):
        seen = current(read_versions(spark, store).where(F.col("generation") < generation).join(own, key, "left_semi"))
        met = now.join(apart(seen.select(*key, F.col("ids").alias("old"), F.col("n").alias("n_old"))), key, "left")
        # a key whose evidence is gone gets a version too, unless its last one says so already
        changed = met.where(~F.col("ids").eqNullSafe(F.col("old")) & ~(F.col("ids").isNull() & F.coalesce(F.col("n_old") == 0, F.lit(True))))
    else:
        changed = now.where("ids is not null")
    changed = cut(changed.select(*key, "ids"))
    status = K.status_at(K.interpretations(direct.join(apart(changed.select(*key)), key, "left_semi")), day)
    out = changed.join(apart(status), key, "left").na.fill({"n": 0, "status": "unknown"})
    out.select(*key, "ids", "n", "status", "candidates", F.lit(generation).cast("long").alias("generation")).write.mode("overwrite").parquet(f"{store}/versions/generation-{generation}")


def maintain(spark: SparkSession, source_dir: str, store: str, day: int, files_per_batch: int = 1) -> DataFrame:
    """Process all files now in ``source_dir`` (further calls take the new ones) and return the current versions."""
    schema = spark.read.parquet(source_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    run = stream.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, store, day)).option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return current(read_versions(spark, store))


def incremental_status(spark: SparkSession, sf_dir: str, day: int, batches: int = 3) -> DataFrame:
    """Status of every key on a day, out of a stream of the table ``events`` in some files, the later events mostly in later ones."""
    store = f"{shared_dir(spark)}/maintain-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").repartitionByRange(batches, "event_id").write.parquet(f"{store}/source")
    out = maintain(spark, f"{store}/source", store, day)
    return out.where("n > 0").select("entity", "attr", "n", "status", "candidates")
