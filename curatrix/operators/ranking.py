"""Top-k per task and url selection. [W1 - W3, W5, A1, A2, O1]"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions.urls import url_domain


def most(tasks: DataFrame, column: str) -> int:
    """The largest number any task asks for: a bound that Spark can cut partitions to."""
    return tasks.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]


def top_k(
    scored: DataFrame, k: int, by: str = "task_id", ties: list[str] | None = None
) -> DataFrame:
    """[W1] The ``k`` best rows of each task with their ``rank``; ties by ``ties`` ascending.

    The constant bound lets Spark cut every partition to k rows per task before the shuffle,
    so one task that holds most of the rows is no bottleneck.
    """
    order = Window.partitionBy(by).orderBy(F.desc("score"), *(ties or ["seq"]))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_snippets(scored: DataFrame, k: int, vectors: bool, ties: list[str] | None = None) -> DataFrame:
    """[W2] As W1; with vector scores long code gets a bonus of up to 0.15."""
    if vectors:
        bonus = F.least(F.lit(0.15), F.length("code") / F.lit(5000.0))
        scored = scored.withColumn("score", F.col("score") + bonus)
    return top_k(scored, k, ties=ties)


def first_rows(rows: DataFrame, k: int | None, by: list[str], order: list[str]) -> DataFrame:
    """[W4] The first ``k`` rows of each group in the given order, or all of them."""
    if k is None:
        return rows
    place = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_place")


def merge_hits(hits: DataFrame, max_items: int | None = None) -> DataFrame:
    """[A1] One row per (task, url): the item of the highest score, the first of equals. ``seq``
    becomes the first occurrence, which also breaks ties of the final order."""
    payload = [c for c in hits.columns if c not in ("task_id", "url", "seq")]
    item = F.struct(*payload)
    merged = hits.groupBy("task_id", "url").agg(
        F.min_by(item, F.struct(-F.col("score"), F.col("seq"))).alias("item"),
        F.min("seq").alias("seq"),
    )
    merged = merged.select("task_id", "seq", "url", "item.*")
    return merged if max_items is None else top_k(merged, max_items).drop("rank")


def best_per_url(scored: DataFrame) -> DataFrame:
    """[A2] Highest score and first occurrence per (task, url)."""
    return scored.groupBy("task_id", "url").agg(
        F.max("score").alias("score"), F.min("seq").alias("seq")
    )


def union_candidates(web: DataFrame, code: DataFrame) -> DataFrame:
    """[O1] Code candidates come after all web candidates of the task."""
    columns = ["task_id", "seq", "url", "score"]
    return web.select(F.lit(0).alias("part"), *columns).unionByName(
        code.select(F.lit(1).alias("part"), *columns)
    ).withColumn("seq", F.struct("part", "seq")).drop("part")


def select_urls(scored: DataFrame, tasks: DataFrame, per_domain: int = K.URLS_PER_DOMAIN) -> DataFrame:
    """[W3] The urls of each task, best first: of the first 2 x max_sources by score at most
    ``per_domain`` of one domain, then the first max_sources.

    ``scored(task_id, seq, url, score)``, ``tasks(task_id, max_sources)``.
    """
    ordered = top_k(best_per_url(scored), 2 * most(tasks, "max_sources"))
    wanted = ordered.join(tasks.select("task_id", "max_sources"), "task_id").filter(
        F.col("rank") <= 2 * F.col("max_sources")
    )
    domain = Window.partitionBy("task_id", "domain").orderBy("rank")
    spread = (
        wanted.withColumn("domain", url_domain(F.col("url")))
        .withColumn("in_domain", F.row_number().over(domain))
        .filter(F.col("in_domain") <= per_domain)
    )
    final = Window.partitionBy("task_id").orderBy("rank")
    return (
        spread.withColumn("place", F.row_number().over(final))
        .filter(F.col("place") <= F.col("max_sources"))
        .select("task_id", "place", "url", "domain", "score")
    )
