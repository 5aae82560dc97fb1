"""Schemas, readers and sinks. [S1, S6, S7]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "url string, status_code int, content_type string, text string, fetched_at timestamp"
TASKS = (
    "task_id bigint, task string, max_sources int, max_code_snippets int, chunk_size int, "
    "allowed_domains array<string>, languages array<string>"
)
SEARCH_HITS = (
    "task_id bigint, query string, seq bigint, title string, href string, url string, body string"
)
REPO_ITEMS = (
    "array<struct<full_name:string,html_url:string,description:string,"
    "stargazers_count:bigint,default_branch:string>>"
)
CODE_ITEMS = (
    "array<struct<path:string,html_url:string,repository:struct<full_name:string,html_url:string>>>"
)
REPO_PAYLOAD = f"task_id bigint, seq bigint, items {REPO_ITEMS}"
CODE_PAYLOAD = f"task_id bigint, seq bigint, items {CODE_ITEMS}"
QUESTIONS = (
    "task_id bigint, seq bigint, question_id bigint, title string, tags array<string>, "
    "is_answered boolean, accepted_answer_id bigint"
)
ANSWERS = "answer_id bigint, body string, score bigint"
ROBOTS = "origin string, body string"
CACHE = "key string, cached_at timestamp, payload string"


def read_table(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """Any of the tables above from parquet, orc or json, with its declared schema."""
    return spark.read.schema(schema).format(format).load(path)


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """[S1]"""
    return read_table(spark, path, PAGES, format)


def pages_of_raw(raw: DataFrame) -> DataFrame:
    """Raw pages ``(page_id, url, html)`` in the crawl layout: fetched, html."""
    return raw.select(
        "page_id",
        "url",
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("text"),
    )


def write_results(records: DataFrame, path: str, run_date: Column, format: str = "json") -> None:
    """[S6] One record per task, appended under its run date."""
    records.withColumn("run_date", run_date).write.mode("append").partitionBy("run_date").format(
        format
    ).save(path)


def write_cache(entries: DataFrame, path: str) -> None:
    """[S7] Appends ``(key, cached_at, payload)``; readers take the newest entry of a key."""
    entries.select("key", "cached_at", "payload").write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """[S7]"""
    return read_table(spark, path, CACHE)
