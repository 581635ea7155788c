"""The registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, licences, media, near, packing, passages, quality, sharding, sql, toxicity, urls
from .fitting import held_out

SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: The rules that the URL query applies.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; TOKENIZER_FILE names another place."""
    if "TOKENIZER_FILE" in os.environ:
        return os.environ["TOKENIZER_FILE"]
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.learn(docs, _read(spark, sf_dir, "labels"))
    out = quality.classify(docs.select("doc_id", "text", "source", "lang"), model)
    digits = {c: F.round(c, 6) for c in ("document_quality", "host_quality", "path_quality", "quality")}
    return out.withColumns(digits).withColumn("held_out", held_out()).select("doc_id", "source", "lang", "held_out", *digits, "keep")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its repeated passages; `repeats` tells those that have any."""
    found = passages.repeated(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, later = passages.merged(F.col("starts")), passages.merged(F.col("later"))

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"])

    return found.select("doc_id", (F.size("starts") > 0).alias("repeats"), "n_words", "first_row", total(spans).alias("n_repeated"), total(later).alias("n_later"), F.array_join(F.transform(spans, lambda p: F.concat_ws("-", p["first"], p["last"])), ",").alias("passages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    places = F.flatten(F.transform(base, lambda m: m["places"]))

    def labels(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"), unnamed=True)
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), contamination.contaminated().alias("contaminated"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("n_bytes"), media.text_picture(F.col("text")).alias("media"))
    back = media.media_columns(stored)
    size = F.octet_length("samples")
    return back.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring(F.col("samples"), size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("dhash").alias("feature"),
        F.octet_length("tile").cast("long").alias("tile_bytes"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_passages, op4_sharding, op5_packing, op6_licences, op7_urls, op8_decontamination, op9_toxicity, op10_media)}


def oracle_sql() -> dict[str, str]:
    """Learned scores, a tokenizer's ids and pictures' hashes are beyond SQL; their tests compare with brute force."""
    return {
        "op2_ngram_join": sql.NGRAM_JOIN, "op3_passages": sql.PASSAGES, "op4_sharding": sql.sharding_sql(SHARDS), "op6_licences": sql.licences_sql(),
        "op7_urls": sql.urls_sql(URL_RULES), "op8_decontamination": sql.DECONTAMINATION,
    }
