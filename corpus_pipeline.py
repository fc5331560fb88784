"""From raw documents to packed sequences, in four stages.

Each stage takes (spark, docs, sf_dir), docs being all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.llm import jaccard, lines, packing, quality
from isotherm.llm.common import table
from isotherm.shared import clear, mark, new_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose score for quality is lower are rejected.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the labelled documents outside the held-out fold.

    Every row is judged by its whole text: repeated rows and equal texts go or stay together, a null text is judged as
    an empty one and stays null, and rows without a doc_id are judged like others. Labels that are null, or whose
    documents are not there, do not count; where no label is left nothing is rejected. Columns beyond those of documents
    are dropped. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    if not len(model.roots) and not model.base:
        return docs
    return quality.filtered(docs, model, LEAST_QUALITY)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines. Those of which no line is left go; n_chars is that of a text that has changed.

    What stood earlier goes by (doc_id, hash of the text), null doc_ids first. Rows equal in both are one document here
    and keep the same lines; texts without words, null and empty ones stay as they are. Columns beyond those of
    documents are dropped. An empty table gives an empty one.
    """
    out = lines.dedup(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group that n-gram similarity links.

    Rows equal in doc_id and text are one document, of which one row stays, null texts being empty. Rows that share a
    doc_id, or have none, but differ in their texts are documents of their own. Documents without a doc_id come after
    those with one, equal doc_ids go by the hash of the text. Texts without words are like no others: each stays.
    Columns beyond those of documents are dropped. An empty table gives an empty one.
    """
    named = docs.select(*COLUMNS).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = named.select(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("__th").alias("th")).alias("id"), "text")
    kept = jaccard.similar(own, key="id").where(F.col("component_id") == F.col("id")).select("id.doc_id", "id.th").distinct().toDF("kept", "th")
    of_groups = named.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("__th") == F.col("th")), "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    return of_groups.groupBy("doc_id", "__th").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", *[f"row.{c}" for c in rest])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row is a document, repeated ones and those without a doc_id as well; null and empty texts have one id, the
    end. Other columns are not looked at. An empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Trees, winnowing, tries and packing cannot be said in SQL; the stages are held against brute force in their tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the cluster's shared folder and read again."""
    docs, folder, begun = table(spark, sf_dir, "documents"), new_path(spark, "pipeline"), mark()
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        clear(spark, begun)  # what the stage's operator has written on its way
    return docs
