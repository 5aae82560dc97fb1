"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item; a shorter item is one window. The
join looks for documents that contain all words of a window in a row.

1. Every document's word shingles are compared with the shingles of all windows, in one pass over
   the texts; what is equal stays as (document, place, shingle).
2. Shingles are ordered by rarity: how often they occur in all documents. Since a window must be
   contained whole, its rarest shingle alone is the necessary prefix; a window of which a shingle
   occurs nowhere is out.
3. Occurrences of prefix shingles propose a start for the window. Positional and length bounds
   drop starts before the text or windows that run beyond its end.
4. Verification is exact: shingles that together cover the window must occur at their places.

Defined results: a null or empty text has no words and no hits; an item without words has no
windows; equal items each count; repeated rows each get a row with equal results, and rows that
share an id but not a text are judged apart; empty tables give no rows or no hits; only the id and
text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.functions.text import let
from curatrix.llm.common import LOWER, UPPER, cut_lineage, free_name, row_key, same_row, text_or_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of the benchmark (about 100 bytes each) that may be broadcast; beyond it both sides
#: are shuffled.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Words of a text in which A-Z are lower-cased: runs of anything but the separators."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER, LOWER), SEPARATORS), "")


def shingles_of(parts: Column, size: int) -> Column:
    """All runs of ``size`` words, space-joined; none if there are fewer."""
    at = F.sequence(F.lit(1), F.size(parts) - (size - 1))
    made = F.transform(at, lambda i: F.array_join(F.slice(parts, i, size), " "))
    return F.when(F.size(parts) >= size, made).otherwise(F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, item: str, text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, item): which items hold a window; (window_id, length, size, offset, shingle):
    every shingle of every window. Equal windows share an id, a hash of 256 bits."""
    read = items.select(F.col(item).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = read.select("item", F.explode_outer(F.transform(starts, lambda i: F.slice("w", i, length))).alias("w"))
    named = each.withColumn("window_id", F.sha2(F.array_join("w", " "), 256))
    distinct = named.select("window_id", "w").distinct()
    size = F.least(F.size("w"), F.lit(shingle))
    places = F.sequence(F.lit(0), F.size("w") - size)
    parts = F.transform(places, lambda i: F.struct(i.alias("offset"), F.array_join(F.slice("w", i + 1, size), " ").alias("shingle")))
    shingled = distinct.select("window_id", F.size("w").alias("length"), size.alias("size"), F.explode_outer(parts).alias("p"))
    return named.select("window_id", "item").distinct(), shingled.select("window_id", "length", "size", "p.offset", "p.shingle")


def _matches(docs: DataFrame, known: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(key, row, n_words, place, shingle): one row with place -1 for every document row, and one
    for each place of a known shingle."""
    empty = F.array().cast("array<struct<place: int, shingle: string>>")

    def placed(parts: Column) -> Column:
        each = [F.transform(shingles_of(parts, s), lambda x, i: F.struct(i.alias("place"), x.alias("shingle"))) for s in sizes]
        return F.concat(empty, *each)

    mark = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("string").alias("shingle")))
    made = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.concat(mark, placed(w)).alias("places")))
    parted = docs.select("key", "row", made.alias("made")).select("key", "row", F.col("made.n_words").alias("n_words"), F.explode_outer("made.places").alias("p"))
    every = parted.select("key", "row", "n_words", "p.place", "p.shingle")
    side = known.select(F.col("shingle").alias("known"))
    if small:
        return every.join(F.broadcast(side), every["shingle"] == side["known"], "left").filter("place = -1 OR known IS NOT NULL").drop("known")
    found = every.filter("place >= 0").join(side, every["shingle"] == side["known"], "left_semi")
    return every.filter("place = -1").unionByName(found)


def contained_windows(docs: DataFrame, shingled: DataFrame, small_rows: int = BROADCAST_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """(key, row, n_words) for every row of ``docs`` (key, row, text), and (key, row, start,
    length, window_id) for every occurrence of a window."""
    shingled = cut_lineage(shingled)
    known = shingled.select("shingle").distinct()
    sizes = sorted(r["size"] for r in shingled.select("size").distinct().collect())  # at most one for each size up to the shingle's
    matches = cut_lineage(_matches(docs, known, sizes, shingled.count() <= small_rows))
    rows, places = matches.filter("place = -1").select("key", "row", "n_words"), matches.filter("place >= 0")
    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("window_id").orderBy("n", "offset")
    whole = Window.partitionBy("window_id")
    counted = shingled.join(rarity, "shingle", "left").withColumns({
        "rank": F.row_number().over(ordered),
        "least": F.min(F.coalesce("n", F.lit(0))).over(whole),
        "last": F.max("offset").over(whole),
    }).filter("least > 0")
    prefix = counted.filter("rank = 1").select("window_id", "length", F.col("offset").alias("at"), "shingle")
    proposed = (
        places.join(prefix, "shingle")
        .select("key", "row", "window_id", "length", (F.col("place") - F.col("at")).alias("start"), "n_words")
        .filter("start >= 0 AND start + length <= n_words")
        .select("key", "row", "window_id", "length", "start")
        .distinct()
    )
    # Shingles at 0, size, 2 * size, ... and the last one cover the window.
    cover = counted.filter("offset % size = 0 OR offset = last").select("window_id", "offset", "shingle")
    needed = cover.groupBy("window_id").agg(F.count(F.lit(1)).alias("needed"))
    wanted = proposed.join(cover, "window_id").select("key", "row", "window_id", "length", "start", (F.col("start") + F.col("offset")).alias("place"), "shingle")
    there = places.select(F.col("key").alias("k"), F.col("row").alias("r"), F.col("place").alias("p"), F.col("shingle").alias("s")).distinct()
    same = wanted["key"].eqNullSafe(there["k"]) & (wanted["row"] == there["r"]) & (wanted["place"] == there["p"]) & (wanted["shingle"] == there["s"])
    held = wanted.join(there, same).groupBy("key", "row", "window_id", "length", "start").agg(F.count(F.lit(1)).alias("held"))
    verified = held.join(needed, "window_id").filter("held = needed").select("key", "row", "window_id", "length", "start")
    return rows, verified


def decontaminate(
    docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str,
    window: int = 13, shingle: int = 5, parts: int = 20,
) -> DataFrame:
    """(key, row, n_words, n_hit, items, contaminated) for every row: hit words, the sorted items
    with an occurring window, and whether at least one word in ``parts`` is hit. ``row`` is
    ``row_key`` of the text."""
    held, shingled = benchmark_windows(items, item, item_text, window, shingle)
    named = docs.select(F.col(key).alias("key"), row_key(F.col(text)).alias("row"), F.col(text).alias("text"))
    rows, found = contained_windows(named, shingled)
    found = cut_lineage(found)
    before = Window.partitionBy("key", "row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", reach))
    places = found.select("key", "row", "start", "length").distinct()
    hit = places.withColumn("new", new).groupBy("key", "row").agg(F.sum("new").alias("n_hit"))
    of_items = (
        found.select("key", "row", "window_id").distinct().join(held, "window_id").select("key", "row", F.col("item").cast("string").alias("item")).distinct()
        .groupBy("key", "row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )

    def with_rows(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnsRenamed({"key": "other_key", "row": "other_row"})
        return left.join(other, left["key"].eqNullSafe(other["other_key"]) & (left["row"] == other["other_row"]), "left").drop("other_key", "other_row")

    joined = with_rows(with_rows(rows, hit), of_items)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("key").alias(key),
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * parts >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, **how: int) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    found = decontaminate(docs, key, text, items, item, item_text, **how).filter("contaminated")
    bad = found.select(F.col(key).alias("bad_key"), F.col("row").alias("bad_row")).distinct()
    row = free_name(docs, "row")
    named = docs.withColumn(row, row_key(F.col(text)))
    return named.join(bad, same_row(named, bad, key, row, "bad_key", "bad_row"), "left_anti").drop(row)
