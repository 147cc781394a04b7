"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskledger.llm import crosstok, html, leaks, lines, packing, pii, quality, quotes, repeats, sharding, simhash, sql, variants, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_sharding", sql.SHARDING)
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = sharding.assign_shards(rows, ["doc_id"], 8)
    rows = sharding.assign_shards(rows, ["doc_id"], 9, "grown_shard")
    rows = sharding.number_slots(rows, ["doc_id"], ["doc_id", "text_crc32", "size"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op5_repeats", sql.REPEATS)
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", *quality.MEASURES)


@query("op1_html")
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op9_warc", sql.WARC)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


@query("op3_leaks")
def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "first", "last", "edits")


@query("op7_lines")
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.remove_lines(table(spark, sf_dir, "documents"), whole=True)
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_quotes", sql.QUOTES)
def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.conversations(table(spark, sf_dir, "conversations"))
    return found.withColumnRenamed("conv", "conv_id")


@query("op11_variants")
def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op12_crosstok")
def op12_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    every = F.sort_array(F.concat("base", "added"))
    return found.select(F.col("id").alias("doc_id"), *pii.counts("base"), F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256"), pii.as_text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))
