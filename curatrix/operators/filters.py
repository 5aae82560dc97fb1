"""Row filters and request validation. [F1, F2, F4 - F7, F11, F13, F14 - F16]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix import constants as K
from curatrix.functions.text import (
    contains_any,
    is_seo_spam,
    let,
    lines,
    redact_secrets,
    strip,
    text_or_empty,
)
from curatrix.functions.urls import domain_error, percent_decoded, suspicious_pattern, url_origin, url_path


def fetched_ok(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Pages with a good status, a text-like type (case-sensitive) and a body, of at most
    ``max_chars`` characters where a bound is asked for."""
    kind = contains_any(F.col("content_type"), K.TEXT_CONTENT_TYPES)
    within = F.col("text").isNotNull() if max_chars is None else F.length("text") <= max_chars
    return pages.filter((F.col("status_code") < 400) & kind & within)


def long_enough(pages: DataFrame, text: str = "text") -> DataFrame:
    """[F4]"""
    return pages.filter(F.length(text_or_empty(F.col(text))) >= K.PAGE_MIN_CHARS)


def not_spam(docs: DataFrame) -> DataFrame:
    """Applied to title and summary."""
    return docs.filter(~is_seo_spam(F.concat_ws(" ", "title", "summary")))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``robots(origin, body)`` to one row per origin: its agent groups in file order as
    array<struct<agents, rules>>, the paths percent-decoded. A group ends at a blank line, or at an
    agent line after rules."""
    line = robots.select("origin", F.posexplode(lines(text_or_empty(F.col("body")))).alias("no", "raw"))
    body = strip(F.substring_index("raw", "#", 1))
    parsed = line.select(
        "origin",
        "no",
        (F.col("raw") == "").alias("blank"),
        F.lower(strip(F.substring_index(body, ":", 1))).alias("key"),
        F.when(F.contains(body, F.lit(":")), strip(F.regexp_replace(body, "^[^:]*:", ""))).alias("value"),
    )
    useful = parsed.filter(
        F.col("blank") | (F.col("value").isNotNull() & F.col("key").isin("user-agent", "allow", "disallow"))
    )
    in_file = Window.partitionBy("origin").orderBy("no")
    before = F.lag("key").over(in_file)
    opens = (F.col("key") == "user-agent") & (
        F.coalesce(before, F.lit("")).isin("", "allow", "disallow")
    )
    grouped = useful.withColumn("grp", F.sum(F.when(opens, 1).otherwise(0)).over(in_file))
    # Rules after a blank line and before the next agent line belong to no group.
    lost = F.max(F.when(F.col("blank"), F.col("no"))).over(
        Window.partitionBy("origin", "grp").orderBy("no")
    ).isNotNull()
    rules = grouped.withColumn("lost", lost).filter(~F.col("blank") & ~F.col("lost") & (F.col("grp") > 0))
    rule = F.struct(
        "no",
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
        percent_decoded(F.col("value")).alias("path"),
    )
    agent = F.col("key") == "user-agent"
    groups = rules.groupBy("origin", "grp").agg(
        F.collect_list(F.when(agent, F.lower("value"))).alias("agents"),
        F.array_sort(F.collect_list(F.when(~agent, rule))).alias("rules"),
    )
    return groups.filter(F.size("rules") > 0).groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("grp", "agents", "rules"))).alias("groups")
    )


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str = "curatrix") -> DataFrame:
    """Pages their origin's robots rules allow; an origin without rules allows all.

    Paths of urls and rules are compared percent-decoded. The rules of an origin are one sorted
    array, decoded once, so a hot origin multiplies no rows.
    """
    name = F.lit(agent.split("/")[0].lower())
    mine = F.filter(
        "groups",
        lambda g: ~F.array_contains(g["agents"], "*")
        & F.exists(g["agents"], lambda a: F.contains(name, a)),
    )
    anyone = F.filter("groups", lambda g: F.array_contains(g["agents"], "*"))
    path = percent_decoded(url_path(F.col("url")))
    decided = let(
        path,
        lambda p: F.get(
            F.filter(
                F.get(F.concat(mine, anyone), F.lit(0))["rules"],
                lambda r: (r["path"] == "*") | F.startswith(p, r["path"]),
            ),
            F.lit(0),
        )["allow"],
    )
    rules = robots_rules(robots)
    joined = pages.withColumn("origin", url_origin(F.col("url"))).join(rules, "origin", "left")
    return joined.filter(F.coalesce(decided, F.lit(True))).drop("origin", "groups")


def task_error(task: Column) -> Column:
    """Why the task is refused, null if it is fine."""
    return (
        F.when(task.isNull() | (strip(task) == ""), "empty")
        .when(F.length(task) > K.TASK_MAX_CHARS, "too long")
        .when(
            suspicious_pattern(task).isNotNull(),
            F.concat(F.lit("suspicious pattern "), suspicious_pattern(task).cast("string")),
        )
    )


def validate_task(tasks: DataFrame, task: str = "task") -> DataFrame:
    """Adds ``task_error`` and the trimmed ``valid_task`` (null if refused)."""
    error = task_error(F.col(task))
    return tasks.withColumn("task_error", error).withColumn(
        "valid_task", F.when(F.col("task_error").isNull(), strip(F.col(task)))
    )


def request_errors() -> Column:
    """All violations of one request row, empty if it is fine."""

    def outside(name: str, bounds: tuple[int, int]) -> Column:
        low, high = bounds
        return F.when(~F.coalesce(F.col(name).between(low, high), F.lit(False)), f"{name} not in {low}..{high}")

    bad_domain = F.exists("allowed_domains", lambda d: domain_error(d).isNotNull())
    checks = F.array(
        F.when(F.length(text_or_empty(F.col("task"))) < K.TASK_MIN_CHARS, "task too short"),
        F.concat(F.lit("task "), task_error(F.col("task"))),
        outside("max_sources", K.MAX_SOURCES),
        outside("max_code_snippets", K.MAX_CODE_SNIPPETS),
        outside("chunk_size", K.CHUNK_SIZE),
        F.when(F.col("max_sources") > K.SAFE_MAX_SOURCES, "max_sources over safe limit"),
        F.when(F.col("chunk_size") > K.SAFE_CHUNK_SIZE, "chunk_size over safe limit"),
        F.when(F.coalesce(bad_domain, F.lit(False)), "invalid domain"),
    )
    return F.filter(checks, lambda e: e.isNotNull())


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds the array ``errors``; rows with an empty array are good."""
    return requests.withColumn("errors", request_errors())


def redact_value(value: Column, kind: T.DataType, name: str | None = None) -> Column:
    """One Column that walks a nested value: strings under a secret name keep four
    characters, all other strings go through the token patterns."""
    if isinstance(kind, T.StringType):
        if name is not None and name.lower() in K.SECRET_KEYS:
            return F.when(
                F.length(value) > 4, F.concat(F.substring(value, 1, 4), F.lit("...[REDACTED]"))
            ).otherwise(redact_secrets(value))
        return redact_secrets(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _redact_entry(k, v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [
            redact_value(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _redact_entry(key: Column, value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        secret = F.lower(key).isin(K.SECRET_KEYS) & (F.length(value) > 4)
        masked = F.concat(F.substring(value, 1, 4), F.lit("...[REDACTED]"))
        return F.when(secret, masked).otherwise(redact_secrets(value))
    return redact_value(value, kind)


def redact_fields(rows: DataFrame) -> DataFrame:
    """Every column of the table, by its schema."""
    return rows.select(
        [redact_value(F.col(f.name), f.dataType, f.name).alias(f.name) for f in rows.schema.fields]
    )


def min_relevance(scored: DataFrame, at_least: float, score: str = "score") -> DataFrame:
    """[F14]"""
    return scored.filter(F.col(score) >= at_least)


def relative_prune(scored: DataFrame, floor: float, share: float, by: str = "task_id") -> DataFrame:
    """Keep rows that score at least ``floor`` and ``share`` of their task's best.

    Meant for ranked rows, of which a task has at most its top-k.
    """
    best = F.max("score").over(Window.partitionBy(by))
    return (
        scored.withColumn("_best", best)
        .filter(F.col("score") >= F.greatest(F.lit(floor), F.col("_best") * share))
        .drop("_best")
    )


def bucketize(scored: DataFrame) -> DataFrame:
    """[F16] Adds ``bucket``; rows below the helpful mark are dropped."""
    bucket = F.when(F.col("score") >= K.CRITICAL, "critical").otherwise("helpful")
    return scored.filter(F.col("score") >= K.HELPFUL).withColumn("bucket", bucket)
