"""Result cache as a table. [J4, A7, S7]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(cached_at: Column, now: Column, ttl_seconds: int | None) -> Column:
    """An entry is fresh up to and including its age limit; without a time stamp it is not.
    ``ttl_seconds=None`` means entries never age."""
    if ttl_seconds is None:
        return F.lit(True)
    limit = F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
    return F.coalesce(now <= cached_at + limit, F.lit(False))


def cache_split(
    requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int | None
) -> tuple[DataFrame, DataFrame]:
    """[J4] (hits with their payload, misses). ``requests(key, ..)``, ``cache(key, cached_at,
    payload)`` with one row per key; only misses need to be worked out again."""
    usable = cache.filter(fresh(F.col("cached_at"), now, ttl_seconds))
    hits = requests.join(usable.select("key", "cached_at", "payload"), "key")
    misses = requests.join(usable.select("key"), "key", "left_anti")
    return hits, misses


def latest_entries(cache: DataFrame) -> DataFrame:
    """The newest entry per key, as a key-value store would hold it."""
    return (
        cache.groupBy("key")
        .agg(F.max(F.struct("cached_at", "payload")).alias("e"))
        .select("key", "e.cached_at", "e.payload")
    )


def hit_rate(hits: Column, misses: Column) -> Column:
    """[A7] Hits over all look-ups, 3 digits, 0 without look-ups."""
    return F.bround(hits / F.greatest(hits + misses, F.lit(1)), 3)
