"""The registered queries of this subpackage: (spark, folder of tables) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.tables import table

from . import divergence, fingerprint, html_extract, mixing, packing, pii, quality, sharding, simhash_dedup, token_count, url_filter, warc, whitening


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, scored=url_filter.scores(pages)).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return derived.select("warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", F.length("block").cast("long").alias("content_length"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_fingerprint": op5_fingerprint,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_token_count": op9_token_count,
    "op10_html": op10_html,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {"op11_divergence": divergence.SQL}
