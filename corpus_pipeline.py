"""The corpus pipeline: documents to packed training batches.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, empty tables and other columns:
rows are told apart by a key of their own, not by doc_id, and other columns do not pass. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import exact, jaccard, langid, packing, pii
from lakeloom.llm.common import clear_scratch, crc_text, scratch, scratch_mark, written
from lakeloom.llm.queries import word_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key for each row, written so that the keys stay what they are."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "pipeline-keyed", compression="zstd")


def _first_of_groups(keyed: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows without those that follow another of their group (``row_key, group_key``; the group's key is the key of one of its rows).

    Of a group the row with the smallest id stays, one without an id behind all others, and of equal ids the one that was read first.
    """
    grouped = written(grouped.select("row_key", "group_key"), "pipeline-groups")
    several = grouped.where("group_key <> row_key")
    members = several.unionByName(several.select(F.col("group_key").alias("row_key"), "group_key").distinct())
    known = members.join(keyed.select("row_key", "doc_id"), "row_key")
    stays = known.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")).select(F.col("best.row_key").alias("row_key"))
    gone = members.select("row_key").join(stays, "row_key", "left_anti")
    return keyed.join(gone, "row_key", "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of undetermined language (no text, or no letter in it) go; the others carry the predicted language.

    Profiles are learned from labelled rows whose crc32(doc_id) mod 4 is not 2, as in the operator's own query; a row without an
    id is learned from. Without a labelled row all are undetermined and go.
    """
    prototypes = langid.train(docs.where(F.coalesce(crc_text("doc_id") % 4 != 2, F.lit(True))))
    found = langid.identify(docs, prototypes, keep=[F.col(c).alias(f"doc_{c}") for c in COLUMNS[1:]])
    kept = found.where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.select("doc_id", F.col("doc_text").alias("text"), F.col("lang_pred").alias("lang"), F.col("doc_source").alias("source"), F.col("doc_n_chars").alias("n_chars"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts (a null one counts as empty) the row with the smallest id stays, as ``_first_of_groups`` says."""
    keyed = _keyed(docs)
    found = exact.exact_dedup(keyed, id_col="row_key", keep="min")
    return _first_of_groups(keyed, found.select(F.col("doc_id").alias("row_key"), F.col("keep_id").alias("group_key")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: five words, similarity 0.8 or more; of each component one document stays, as ``_first_of_groups`` says.

    Texts without words have no links and stay.
    """
    keyed = _keyed(docs)
    found = jaccard.jaccard_components(keyed, id_col="row_key", words=5, num=8, den=10)
    return _first_of_groups(keyed, found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("group_key")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span found is replaced by its kind in brackets. All rows stay, repeated ones too; a null text becomes an empty one."""
    found = pii.detect(docs, keep=[F.col(c) for c in COLUMNS[2:]])
    clean = pii.redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", clean.alias("text"), "lang", "source").select(*COLUMNS[:4], F.length("text").cast("long").alias("n_chars"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: length buckets and token-budget batches of all documents that remain, by their ids in the word vocabulary.

    Null texts count as empty; repeated rows and rows without an id have a place each.
    """
    return packing.pack(docs, vocabulary=word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("personal_data", personal_data),
    ("packing", batches),
]

#: Learned profiles and the span classifier cannot be written in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to shared storage and read again; a stage's scratch goes when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, f"pipeline-{name}")
        out.write.parquet(path)
        clear_scratch(mark, keep=[path])
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
