"""The store: batches, versions, barrier, outbox, export and erasure, as joins over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.scalars import form_fits, json_text

CHUNK = 65536


def match_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """idem, outcome of each key of a batch: ``new``, ``replay`` (stored with equal content) or ``conflict``. The first row of a key counts."""

    def first(df: DataFrame) -> DataFrame:
        return df.groupBy("idem").agg(F.min_by("content", "lsn").alias("content"))

    met = first(batch).join(first(stored).withColumnRenamed("content", "old"), "idem", "left")
    return met.select("idem", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content"), "replay").otherwise("conflict").alias("outcome"))


def running_max(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``upto``, the greatest ``value`` so far in ``order`` (a whole number). Two levels: inside chunks of the order, and
    over the maxima of earlier chunks; so no task sorts the table."""
    df = df.withColumn("chunk", F.floor(F.col(order) / CHUNK))
    tops = df.groupBy("chunk").agg(F.max(value).alias("top"))
    before = F.max("top").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("chunk", before.alias("before"))  # one row per CHUNK rows
    inside = F.max(value).over(Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("inside", inside).join(tops, "chunk").withColumn("upto", F.greatest("inside", "before")).drop("chunk", "inside", "before")


def export_lines(log: DataFrame) -> DataFrame:
    """lsn, line: canonical JSON (fields by name, no blanks)."""
    val = F.coalesce(json_text(F.col("value")), F.lit("null"))
    line = F.concat(F.lit('{"attr":'), json_text(F.col("attr")), F.lit(',"cue":'), json_text(F.col("cue")), F.lit(',"entity":'), json_text(F.col("entity")), F.lit(',"lsn":'), F.col("lsn").cast("string"), F.lit(',"value":'), val, F.lit("}"))
    return log.select("lsn", line.alias("line"))


def import_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_json("line", "attr string, cue string, entity string, lsn long, value string").alias("r")).select("r.*")


def versions(log: DataFrame) -> DataFrame:
    """The log with the version number each report gives its key."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("entity", "attr").orderBy("lsn")))


def subscriptions(log: DataFrame) -> DataFrame:
    """plan, entity, attr of the keys that plans watch (a fixture)."""
    return log.where("k % 5 = 0").select(F.concat(F.lit("p"), (F.col("k") % 3).cast("string")).alias("plan"), "entity", "attr").distinct()


def outbox(version: DataFrame, subs: DataFrame) -> DataFrame:
    """One event per subscribed plan and version change; the id depends on nothing else, so delivering again is harmless."""
    old = (F.col("version") - 1).cast("string")
    out = version.select("entity", "attr", "version").join(subs, ["entity", "attr"])
    return out.select("plan", "entity", "attr", "version", F.sha2(F.concat_ws("|", "plan", "entity", "attr", old, F.col("version").cast("string")), 256).alias("event_id"))


def id_set():
    """Aggregate that tells sets of report ids apart, in any order and by partial sums: their number and two sums of hashes."""
    return F.struct(F.count("rid").alias("n"), *[F.sum(F.xxhash64("rid", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in range(2)])


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity, attr of the keys whose direct ids differ between two evaluations."""

    def ids(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("entity", "attr").agg(id_set().alias(name))

    return ids(before, "a").join(ids(after, "b"), ["entity", "attr"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("entity", "attr")


def generations(log: DataFrame) -> DataFrame:
    """Required and completed generation and flags of each key (a fixture of marks and jobs)."""
    return log.groupBy("entity", "attr").agg(
        F.max("lsn").alias("required"), F.max(F.when(F.col("k") % 4 != 0, F.col("lsn"))).alias("completed"), F.bool_or(F.col("k") == 50).alias("dirty"),
        F.bool_or(F.col("k") == 51).alias("erased"), F.max_by(F.col("k") % 9 == 0, "lsn").alias("incomplete"),
    )


def barrier(gen: DataFrame) -> DataFrame:
    """entity, attr, outcome of a read: a stale belief is never served as current."""
    why = (
        F.when(F.col("dirty"), "store_dirty").when(F.col("completed").isNull(), "stale_dependency").when(F.col("erased"), "not_reconstructable")
        .when(F.col("incomplete"), "inference_incomplete").when(F.col("required") > F.col("completed"), "stale_dependency").otherwise("belief")
    )
    return gen.select("entity", "attr", why.alias("outcome"))


def erase(log: DataFrame, gone: DataFrame) -> DataFrame:
    """entity, attr, live, tombstones of the keys that an erasure touches: what has to be computed again."""
    marked = log.join(gone.select("lsn", F.lit(True).alias("erased")), "lsn", "left")
    by = marked.groupBy("entity", "attr").agg(F.count_if(F.col("erased").isNull()).alias("live"), F.count("erased").alias("tombstones"))
    return by.where("tombstones > 0")


def build_reports(log: DataFrame, allowed=("assert", "change", "correct", "allege")) -> DataFrame:
    """rid, outcome: what becomes of each claim, in the order of the checks: cue, attribute, form, target."""
    k = F.col("k")
    attr = F.when(k % 10 == 4, "shoe_size").otherwise(F.col("attr"))
    form = F.when((k % 13 == 0) & F.col("form").isNotNull(), "member").otherwise(F.col("form"))
    why = (
        F.when(~F.col("cue").isin(*allowed), "cue_not_permitted").when(attr == "shoe_size", "undeclared_attr")
        .when(form.isNotNull() & ~form_fits(form, F.col("attr")), "form_mismatch").when(F.col("cue").isin("correct", "allege") & (F.col("target") < 0), "target_unresolved").otherwise("report")
    )
    return log.select("rid", why.alias("outcome"))
