"""The training-data queries: thin callers that derive the contract's columns
from the operators' results. ``QUERIES`` maps a name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (blobscan, bpe, decontam, hardneg, licenses, maxent, neardup, quality, simhash, spelling, surrogates,
                           urlfilter, warc)
from plumbline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blobscan.scan_history(table(spark, sf_dir, "documents"), path_col="doc_id")
    base = [r.kind for r in blobscan.BASE_RULES]
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        listed("found").alias("spans"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, table(spark, sf_dir, "pages"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      F.array_join("base_labels", ",").alias("base_labels"),
                      F.array_join("labels", ",").alias("labels"), "score")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page fetched on a day given by its id, against a list whose history
    is derived from the hosts of the pages: a third of the hosts and of their
    parent domains are listed some time, taken off again, and some listed anew."""
    pages = table(spark, sf_dir, "pages")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 7919, F.lit(730))).alias("fetched"))
    keys = pages.select(F.explode(urlfilter.domain_keys(urlfilter.host_of(F.col("url")))).alias("key")).distinct()
    n = F.conv(F.substring(F.md5("key"), 1, 4), 16, 10).cast("int")
    category = F.element_at(F.array(*map(F.lit, ("ads", "adult", "malware"))), n % 3 + 1)
    event = lambda a, d: F.struct(F.lit(a).alias("action"), day(d).alias("day"))
    dated = F.array(event("add", n % 600), event("remove", n % 600 + 30 + n % 170), event("add", n % 600 + 260 + n % 90))
    events = keys.withColumns({"n": n, "category": category}).where("n % 3 = 0 or n % 7 = 0")
    events = events.select("key", "category", F.explode(F.when(F.col("n") % 2 == 0, dated).otherwise(
        F.slice(dated, 1, 2))).alias("e")).select("key", "category", "e.action", "e.day")
    out = urlfilter.evaluate(captures, events)
    return out.withColumn("categories", F.array_join("categories", ","))


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_pii(table(spark, sf_dir, "documents"), key="rehearsal key")


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label))


@query
def op13_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
