"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

1. ``language_id``: documents without a letter, and those that no learned language describes (coding them costs more
   than storing their bytes, with ``ALLOWED_BITS`` to spare) go; a document without a language gets the predicted one.
2. ``line_dedup``: lines that repeat an earlier passage of three lines go; a document of which nothing is left goes.
3. ``jaccard_join``: of each group of near duplicates, the document with the smallest id stays, once; of several rows
   with that id, the one that orders first by text, then by its columns. Documents without an id are in no group and stay.
4. ``decontamination``: documents that hold a window of a benchmark item go.
5. ``byte_bpe``: texts become token ids; ``text`` is what the ids decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, decontaminate, jaccard_join, lang_id, line_dedup
from tidebook.llm.components import kept
from tidebook.llm.marks import marks_of, with_marks

#: Stages that decode to UTF-8 text and learn from samples are not SQL.
ORACLE_SQL = None

#: What a document's code may have over its own size: short texts may begin in rare ways.
ALLOWED_BITS = 64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lang_id.identify(docs, lang_id.train(docs))
    described = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("bits") <= 8 * F.col("bytes") + ALLOWED_BITS)
    return found.where(described).withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(docs)
    left = (F.size("removed") == 0) | (F.trim("text") != "")
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = kept(jaccard_join.clusters(docs), "clusters")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    several = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    decided = gone.select("doc_id", F.lit(False).alias("several")).unionByName(several.select("doc_id", F.lit(True).alias("several")))
    clear, asked = divided(docs, kept(decided, "decided"))
    same = asked.where("_several").groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.struct(F.col("text").alias("first"), F.struct(*docs.columns).alias("then"))).alias("d")
    )
    one = same.select(*(F.col(f"d.{c}") for c in docs.columns))
    return clear.unionByName(asked.where("_several IS NULL").select(docs.columns)).unionByName(one)


def divided(docs: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that are surely not among those decided on, mostly by far the larger part, whose texts are not shuffled;
    and the others, joined with what was decided."""
    placed = with_marks(docs, "doc_id", marks_of(decided, "doc_id"), "_held")
    asked = placed.where("_held").select(docs.columns).join(decided.withColumnRenamed("several", "_several"), "doc_id", "left")
    return placed.where("NOT _held").select(docs.columns), asked


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark).where(F.size("hits") == 0).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select("doc_id", "lang", "source", "text")
    # Decoded where they are encoded: two passes in one stage would be two workers for each task.
    return bpe.encode(rows, ranks, public_tokenizers.PATTERN, decoded="decoded").select(
        "doc_id", "lang", "source", F.col("decoded").cast("string").alias("text"), F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
