"""The registered queries of this subpackage: opN_<name>, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import bpe, chat, decontaminate, langid, license, linededup, quality, simhash, urlfilter, warc
from .common import new_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.planned(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return warc.summaries(warc.read(spark, path)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(chat.planted(spark))
    return chat.digests(rows)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "containment")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = linededup.duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return gone.select(F.col("k.id").alias("doc_id"), F.col("n").alias("line_no"), F.col("keeper.k.id").alias("keeper_doc_id"), F.col("keeper.n").alias("keeper_line_no"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.verdicts(pages, urlfilter.rules_frame(spark)).select("row.page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license.scan(docs).select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_simhash, op3_warc, op4_chat_format, op5_decontamination, op6_quality_rules, op7_line_dedup, op8_url_filters, op9_license_scan, op10_language_id)}

ORACLE_SQL = {"op3_warc": warc.SQL, "op4_chat_format": chat.SQL, "op5_decontamination": decontaminate.SQL, "op6_quality_rules": quality.SQL, "op8_url_filters": urlfilter.SQL, "op9_license_scan": license.SQL}
