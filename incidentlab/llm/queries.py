"""Registered queries: one ``opN_<name>`` per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (exact_dedup, hard_negatives, html_extract, langid, mixing, pii, quality, secret_scan, simhash,
               spelling, spiece, toxicity, url_filter)
from .common import read
from .url_seeds import labelled_urls

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf, "documents"))


def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return mixing.mix(docs, mixing.train(docs, read(spark, sf, "labels")))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    labelled = spark.createDataFrame(labelled_urls(), "url string, blocked int")
    return url_filter.judge(read(spark, sf, "pages"), url_filter.train(labelled), RULES,
                            threshold=url_filter.held_out_threshold(labelled))


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan_documents(read(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    return toxicity.judge(docs, toxicity.train(docs, read(spark, sf, "labels")))


def op6_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf, "pages"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(read(spark, sf, "documents"), labels=read(spark, sf, "labels"))


def op8_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    out = langid.identify(docs, learn=part != 1, calibrate=part == 2)
    return out.withColumn("held_out", part == 1)


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return spiece.encode_documents(read(spark, sf, "documents"), tokenizer_path(), with_ids=False)


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf, "documents"))


def op11_spelling(spark: SparkSession, sf: str) -> DataFrame:
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    words = (spelling.runs(read(spark, sf, "documents")).withColumn("h", h)
             .select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")))
    return spelling.variants(spelling.vocabulary(words))


def op12_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan_documents(read(spark, sf, "documents"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf, "embeddings"), label=label, is_anchor=F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_mixing": op2_mixing,
        "op3_url_filter": op3_url_filter,
        "op4_secret_scan": op4_secret_scan,
        "op5_toxicity": op5_toxicity,
        "op6_html_extract": op6_html_extract,
        "op7_quality": op7_quality,
        "op8_langid": op8_langid,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_spelling": op11_spelling,
        "op12_pii": op12_pii,
        "op13_hard_negatives": op13_hard_negatives,
    }
