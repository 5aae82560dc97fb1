"""Connected components of an edge table, for the operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns a, b): root is the smallest node
    that is reachable.

    Alternates the large-star and small-star steps, which move each node's larger (then smaller)
    neighbours to its smallest one, until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. A node with very many neighbours is only ever the key of a
    map-side combined minimum and of plain joins, which Spark splits where they are skewed. Rounds
    cut their lineage by a reliable checkpoint.
    """
    current = cut_lineage(_toward_smaller(edges.filter("a <> b")))
    state = _state(current)
    while state[0]:
        moved = _large_star(current)
        current = cut_lineage(_small_star(moved))
        before, state = state, _state(current)
        if state == before:
            break
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    alone = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return roots.unionByName(alone)


def _toward_smaller(edges: DataFrame) -> DataFrame:
    """Each link once, as (larger, smaller)."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)), F.sum(mixed.cast("decimal(38, 0)")), F.bit_xor(mixed)).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _toward_smaller(others.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b"))
