"""Registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skewlens.session import configure

from . import (
    decontaminate, line_dedup, mixing, ordinal, perspectives, phrases, pii, quality_rules, simhash, spelling, suffix_dedup, token_files, warc,
)
from .oracles import ORACLES  # noqa: F401  (re-exported)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


@query
def op1_skip_chain_pii(spark, sf):
    out = pii.find_personal_data(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query
def op2_ordinal_quality(spark, sf):
    return ordinal.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op3_decontamination(spark, sf):
    return decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query
def op4_line_dedup(spark, sf):
    out = line_dedup.dedup_lines(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_perspectives(spark, sf):
    return perspectives.rotate(_table(spark, sf, "conversations"))


@query
def op6_simhash(spark, sf):
    out = simhash.near_duplicates(_table(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_token_files(spark, sf):
    return token_files.token_files(_table(spark, sf, "documents"))


@query
def op8_warc_derivatives(spark, sf):
    out = warc.derive(warc.responses(_table(spark, sf, "pages")))
    return out.select(
        F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest",
        "block_digest", "content_length", F.col("block").cast("string").alias("block"),
    )


@query
def op9_mixing(spark, sf):
    out = mixing.mix(_table(spark, sf, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op10_host_rules(spark, sf):
    out = quality_rules.quality_rules(_table(spark, sf, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected",
        "symbols", "lines", *[F.round(f"{r}_rate", 6).alias(f"{r}_rate") for r in quality_rules.RULES],
    )


@query
def op11_suffix_dedup(spark, sf):
    out = suffix_dedup.remove_repeats(_table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_spelling(spark, sf):
    return spelling.spelling_variants(_table(spark, sf, "documents"))


@query
def op13_phrases(spark, sf):
    return phrases.mine_phrases(_table(spark, sf, "documents"))
