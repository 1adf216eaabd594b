"""A corpus pipeline: quality filter, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the docs of the next one; all but
the last return the columns of `documents`, the last one row per document with its token digests.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.llm import byte_bpe, jaccard_join, mixing, quality, suffix_dedup
from tabulane.llm.common import held_out, load
from tabulane.session import cut_lineage, shared_dir

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def _any_names(stage):
    """The stage on a table whose other columns may have any names, also those that a stage uses itself."""

    @functools.wraps(stage)
    def renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in OWN else f"extra_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    return renamed


@_any_names
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts. It learns from the labelled documents that are not held out; without labels of both kinds it rejects nothing unlearned.

    Each text is read once: rejected rows go by (id, hash of the text), so rows of one id are judged by their own texts and rows equal
    in both alike. Null texts count as empty, null ids are judged too but never learned from; an empty table gives none; other columns pass unread.
    """
    stats = cut_lineage(quality.document_statistics(docs))
    model = quality.learn_quality(stats, load(spark, sf_dir, "labels"), ~held_out())
    rejected = quality.score_statistics(stats, model).filter(F.col("score") < quality.ACCEPT)
    rejected = cut_lineage(rejected.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tag")), "left_anti")


@_any_names
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, then the smallest text hash; rows of one id are grouped by their texts.

    Null and wordless texts are in no group and all stay; a null id comes after all others; an empty table gives none; other columns pass unread.
    """
    return jaccard_join.drop_near_duplicates(docs)


@_any_names
def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occur earlier; n_chars follows. A text that is wholly repeated becomes empty.

    Null texts stay null; null ids come after all others, rows of one id go by the hash of their text, rows equal in both are one document;
    an empty table gives none; other columns pass unread.
    """
    return _with_length(suffix_dedup.strip_repeats(docs)).select(*docs.columns)


@_any_names
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in its order: pass by pass, each in the order of its permutation.

    Sources below their weight repeat in a later pass, sources above it are cut by the budget. Rows equal in id, text and source are one
    document, used as often as the mix uses all of them; null ids, texts and sources are values of their own; sources without any word
    are left out; an empty table gives none; other columns pass unread.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        id_key, source_key = (F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source"))
        return rows.withColumns({"_id_key": id_key, "_source_key": source_key})

    keys = ["_id_key", "_source_key", "_tag"]
    uses = keyed(mixing.mix_sources(docs)).withColumnRenamed("tag", "_tag")
    uses = cut_lineage(uses.groupBy(*keys, F.col("pass").alias("_pass"), F.col("order_key").alias("_order")).agg(F.count(F.lit(1)).cast("int").alias("_times")))
    own = keyed(docs).withColumn("_tag", F.xxhash64("text"))
    if not uses.filter("_times > 1").isEmpty():
        own = own.dropDuplicates(keys)
    used = own.join(uses, keys).withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return used.orderBy("_pass", "_order", *keys).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left, one row each: null texts count as empty, null ids and repeated rows stay; an empty table gives none."""
    return byte_bpe.token_digests(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_array_dedup", repeated_passage_stage),
    ("source_mixing", mixing_stage),
    ("byte_level_bpe", token_stage),
]

ORACLE_SQL = None  # SQL has no quadratic discriminant fit


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder before the next one reads it."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
