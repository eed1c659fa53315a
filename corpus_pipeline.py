"""A corpus pipeline of five training-data operators: language ID, near-duplicates, personal data, mixing, packing.

Each stage works on all that the stage before it kept. All but the last return the columns of documents. For every stage: a null text
is an empty one, a null id, lang or source is a value of its own, repeated rows are separate documents (but for near-duplicates, which
keep one), very long texts are read whole, other columns of any name pass through, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, mixing, neardup, packing, pii
from attesta.llm.common import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture inference names a language for; those without a letter (``und``), so null and empty texts too, go. It
    learns from the documents with a lang that are not held out; where there are none, documents with a letter stay."""
    langs, like = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not langs:
        return docs.where(F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    return langid.predict(docs, langs, like, keep_text=True).where(F.col("lang_pred") != "und").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id (null last). Equal texts, null and empty ones among
    them, are one class; of rows equal in id and text one stays."""
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced by the name of their kind; a null text stays null, and n_chars is
    that of the new text."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or twice; null sources are one source. Rows of equal id are taken
    equally often; texts without words weigh nothing and go or stay by their draw."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the token-budget batches; a text without words has length 0, one beyond the budget a batch of its own."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix_sources", mix_sources), ("packing", pack)]

#: Mixture inference and alignment cannot be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
