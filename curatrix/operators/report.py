"""Counts and quality figures per task. [A4 - A7]"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix import constants as K


def content_diversity(selected: DataFrame) -> DataFrame:
    """[A6] Distinct domains over selected urls per task."""
    return selected.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("sources_found"),
        (F.countDistinct("domain") / F.count(F.lit(1))).alias("content_diversity"),
    )


def ranked_figures(ranked: DataFrame, name: str) -> DataFrame:
    """[A4, A5] Ranked rows, average score and bucket sizes per task, before noise is dropped."""
    return ranked.groupBy("task_id").agg(
        F.count(F.lit(1)).alias(f"{name}s_ranked"),
        F.avg("score").alias(f"avg_{name}_relevance"),
        F.count_if(F.col("score") >= K.CRITICAL).alias(f"critical_{name}s"),
        F.count_if((F.col("score") >= K.HELPFUL) & (F.col("score") < K.CRITICAL)).alias(f"helpful_{name}s"),
    )


def row_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias(name))


def run_report(tasks: DataFrame, *parts: DataFrame) -> DataFrame:
    """[A4] All figures side by side, one row per task, 0 where a task has none. Selected urls
    without an extracted page are ``pages_failed``."""
    joined = reduce(
        lambda left, right: left.join(right, "task_id", "left"), parts, tasks.select("task_id")
    )
    filled = joined.fillna(0)
    if {"sources_found", "pages_extracted"} <= set(filled.columns):
        filled = filled.withColumn("pages_failed", F.col("sources_found") - F.col("pages_extracted"))
    return filled


def bucket_report(bucketed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, average score and average quality label by bucket."""
    return (
        bucketed.join(labels, "doc_id", "left")
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("score").alias("avg_score"),
            F.count("quality").alias("labelled"),
            F.avg("quality").alias("avg_quality"),
        )
    )
