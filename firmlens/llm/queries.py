"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core.scratch import Scratch
from . import bpe, imatch, linededup, lm, media, mixing, negatives, quality, shards, simhash, spelling, tokenfiles, toxicity

#: A score from which a text is predicted to have the label.
THRESHOLD = 0.3


def vocabulary() -> str:
    """The vocabulary file of the contracts, which every node has."""
    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(_documents(spark, sf_dir), vocabulary(), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    aside = quality.held_out("doc_id", 5, 0)
    model = quality.fit(docs, _labels(spark, sf_dir), ~aside)
    return model.score(docs, keep=["doc_id"]).select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(_documents(spark, sf_dir), keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        media.fingerprint_text().alias("feature"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_documents(spark, sf_dir), Scratch(spark, "simhash"), keep=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    flags = imatch.lexicon(docs)
    paired = imatch.with_next(docs, ["text"], tie="text")
    first = imatch.with_fingerprint(imatch.with_fingerprint(paired, "text", flags, "fp"), "next_text", flags, "next_fp")
    changed = first.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fp", "next_fp", imatch.edited(F.col("text"), F.col("next_text")).alias("edited"))
    second = imatch.with_fingerprint(changed, "edited", flags, "edited_fp")
    return second.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        imatch.as_text(F.col("fp")).alias("fingerprint"),
        imatch.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        imatch.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        imatch.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_dedup(_documents(spark, sf_dir), Scratch(spark, "lines"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    aside = quality.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, _labels(spark, sf_dir), ~aside)
    return model.score(docs, keep=["doc_id"]).select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    aside = quality.held_out("doc_id", 5, 1)
    out = lm.score(_documents(spark, sf_dir), ~aside, vocabulary(), Scratch(spark, "lm"), keep=["doc_id"])
    return out.select("doc_id", aside.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write(_documents(spark, sf_dir), Scratch(spark, "tokens").where("files"), vocabulary())
    return files.read(spark).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    dims = {"source": shards.order_of("source"), "lang": shards.order_of("lang"), "bytes": F.log2(shards.size_of()), "doc_id": shards.number("doc_id")}
    out = shards.kd_shards(docs, Scratch(spark, "shards"), dims, shards=16, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir), Scratch(spark, "spelling")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(rows.withColumn("label", moved), Scratch(spark, "negatives"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_media": op3_media,
    "op4_simhash": op4_simhash,
    "op5_imatch": op5_imatch,
    "op6_toxicity": op6_toxicity,
    "op7_lm": op7_lm,
    "op8_tokenfiles": op8_tokenfiles,
    "op9_mixing": op9_mixing,
    "op10_linededup": op10_linededup,
    "op11_sharding": op11_sharding,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.ORACLE_SQL, "op13_negatives": negatives.ORACLE_SQL}
