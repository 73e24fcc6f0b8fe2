"""Corpus pipeline: language ID, quality classifier, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import byte_cnn, langid, near_dup, packing
from marquee.llm._common import materialise, table
from marquee.llm.queries import labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its likeliest language has less than this share of its words.
LEAST_LANGUAGE_SHARE = 0.5
#: A document goes if the network gives it less than this probability of good quality.
LEAST_QUALITY = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; those without a letter go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model, extra=[F.col(c) for c in COLUMNS if c not in ("doc_id", "text")] + [F.col("text").alias("_kept_text")])
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SHARE)).withColumnRenamed("_kept_text", "text").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on the labelled ones among them, does not reject."""
    model = byte_cnn.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", byte_cnn.MAX_TRAIN_DOCS))
    scored = byte_cnn.score(docs, model, extra=[F.col(c) for c in COLUMNS if c not in ("doc_id", "text")] + [F.col("text").alias("_kept_text")])
    return scored.where(F.col("score") >= LEAST_QUALITY).withColumnRenamed("_kept_text", "text").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one with the least id, of several such any one; a null id comes last.

    Rows are told apart by a written key, so ids may be null, repeated or shared by different texts. Rows without words are each a group.
    """
    rows = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_dup.near_duplicates(rows, id_col="_row").join(rows.select("_row", "doc_id"), "_row")
    kept = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document, their ids included, with their sequence and offset."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Trained models, sketches and tokenizers have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread before the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
