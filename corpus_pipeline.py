"""The corpus pipeline: language, near duplicates, contamination, source weights, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinderframe.llm._frames import Scratch
from cinderframe.llm.decontaminate import decontaminate
from cinderframe.llm.language_id import keep_languages, train
from cinderframe.llm.near_dedup import near_groups
from cinderframe.llm.source_mix import mixed_documents
from cinderframe.llm.token_files import token_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null, letterless and unrecognisable texts go.

    Without labelled text to train on, every text with a letter stays. Each row is judged by its text alone, so
    repeated rows and rows with a null id stay or go together; other columns pass unread. Empty in, empty out.
    """
    return keep_languages(docs, train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id (nulls last), then text digest.

    Of rows with equal id and text one stays, that with the smallest other columns, written as JSON; null and empty text are one
    text. A text without words is in no group and stays. Rows with a null id are rows like others: they are told
    apart by their text. Empty in, empty out.
    """
    rows = near_groups(docs).groupBy("id", "text_key").agg(F.first("label").alias("label"), F.count("*").alias("n"))
    best = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best"))
    gone = F.col("best").isNotNull() & ~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_key") == F.col("best.text_key")))
    marked = rows.join(best, "label", "left").select(F.col("id").alias("m_id"), F.col("text_key").alias("m_key"), gone.alias("m_gone"), "n").filter("m_gone or n > 1")
    marked = Scratch(spark, "near_rows").cut(marked)
    same = docs.doc_id.eqNullSafe(marked.m_id) & (F.md5(F.coalesce(docs.text.cast("binary"), F.lit(b""))) == marked.m_key)
    others = F.to_json(F.struct(F.lit(0).alias("0"), *[c for c in docs.columns if c not in ("doc_id", "text")]))  # columns of any type, maps too
    repeated = docs.join(marked.filter("not m_gone"), same, "left_semi").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("same")).agg(F.min_by(F.struct(*docs.columns), F.struct(others, F.col("text").isNotNull())).alias("x"))
    return docs.join(marked, same, "left_anti").union(repeated.select("x.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null texts have no words and stay, repeated rows stay or go together.

    An empty benchmark, or items without words, remove nothing. Empty in, empty out.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the weighted mix, one row for each time that the mix takes them (at most three).

    A null source is a source, last in order; texts without words are never taken; rows with equal id, source and
    size take turns. Empty in, empty out.
    """
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files written and read back: doc_id, start, n_tokens and ids_crc32, a row per row.

    Null ids come first, null texts hold the end alone, rows with equal ids follow each other by text. Empty in, empty out.
    """
    return token_table(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("token_files", token_files)]

#: SQL cannot express the network of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's output is written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        done = scratch.cut(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = done
    return docs
