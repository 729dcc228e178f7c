"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_text, mixing, neighbours, passages, ppm, quality, simhash, token_counts, warc
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(k: int):
    """crc32 of doc_id as text, modulo k; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(k))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_with_edits(docs, token_counts.sample_edits(F.col("doc_id"), F.col("text")))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), crc_mod(7) != 2)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op_rows(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(3) == 1
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.mark_repeats(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda x: F.struct(x["s"].alias("start_word"), x["e"].alias("end_word"), x["ref_id"].alias("first_doc_id")))
    return found.select("doc_id", "n_words", "n_dup_words", spans.alias("spans"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    written = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder, written=written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_ppm, op4_neighbours, op5_decontamination, op6_quality, op7_simhash, op8_passages, op9_html, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {}
