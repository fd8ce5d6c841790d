"""Registered queries of the corpus operators: name -> (query, SQL twin or None)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat, digest, divergence, langid, linededup, mixing, negatives, neighbours, pieces, quality,
    simhash, toxicity, wrapper)

# A conversation whose texts are nothing but control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edit_likeness(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame(
        [(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)],
        "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(hostile)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_verdicts(docs).drop("rejected_by")


QUERIES = {
    "op1_simhash": (op1_simhash, None),
    "op2_mixing": (op2_mixing, mixing.ORACLE),
    "op3_fingerprints": (op3_fingerprints, None),
    "op4_neighbours": (op4_neighbours, None),
    "op5_language_id": (op5_language_id, None),
    "op6_line_dedup": (op6_line_dedup, None),
    "op7_sentencepiece": (op7_sentencepiece, None),
    "op8_html_extraction": (op8_html_extraction, None),
    "op9_chat_formatting": (op9_chat_formatting, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_divergence": (op11_divergence, divergence.ORACLE),
    "op12_hard_negatives": (op12_hard_negatives, negatives.ORACLE),
    "op13_quality_rules": (op13_quality_rules, quality.ORACLE),
}
