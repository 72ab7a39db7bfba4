"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.llm import chat, decontam, grammar, jaccard, langid, licenses, mixing, pii, quality, urls


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: The list that pages are judged by, as dated changes.
URL_CHANGES = [
    ("spam-farm.example.org", "add", "block", "2024-02-10"),
    ("spam-farm.example.org", "remove", "block", "2024-07-01"),
    ("spam-farm.example.org", "add", "block", "2024-10-15"),
    ("cheap-pills.example.com", "add", "block", "2024-01-20"),
    ("cheap-pills.example.com", "remove", "block", "2024-11-05"),
    ("cheap-pills.example.com/en", "add", "allow", "2024-05-01"),
    ("tionsh.example.net", "add", "block", "2024-03-01"),
    ("tionsh.example.net", "remove", "block", "2024-04-01"),
    ("blog.tionsh.example.net", "add", "allow", "2024-03-10"),
    ("example.net/fr", "add", "block", "2024-06-01"),
    ("example.org", "add", "block", "2024-08-01"),
    ("example.org", "remove", "block", "2024-08-15"),
    ("www.example.org", "add", "allow", "2024-08-05"),
    ("example.net", "add", "block", "2024-01-15"),
    ("example.net", "add", "allow", "2024-02-15"),
    ("example.net", "remove", "allow", "2024-05-15"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = spark.createDataFrame(URL_CHANGES, "entry string, action string, list string, changed_on string")
    pages = table(spark, sf_dir, "pages")  # without a fetch date; the query gives each page one
    captures = pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 7, 366) AS INT))").alias("fetched_on"))
    return urls.judge(captures, changes.withColumn("changed_on", F.col("changed_on").cast("date")))
