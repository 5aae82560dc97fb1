"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

1. Seeds: fixed patterns find emails, IP addresses, card numbers and phone numbers.
2. Candidates: other tokens that look like identifiers (a digit and at least five characters, or an
   ``@`` within).
3. Each occurrence of a seed or candidate induces lexical patterns: the two words before it, the
   three words before it, and the word on either side. Words are whole, however long; white space
   parts them, as do the ends of matches of the same kind.
4. A graph joins patterns and instances (distinct strings, so copies of a document count once).
   Spark scores it in rounds, until no confidence changes: a pattern's confidence for a kind is the mean score of its
   instances; a candidate's score is one minus the product of its confident patterns' doubts.
5. Candidates whose score reaches the limit are identifiers of that kind, wherever they occur.

Defined results: a null or empty text has no spans; a candidate that overlaps a seed is none;
repeated rows each get a row with equal spans, and rows that share an id but not a text are
apart; an empty table gives no rows; only the id and text columns are read. Spans are code points,
the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.functions.text import let
from curatrix.llm.common import cut_lineage, free_name, row_key, same_row, text_or_empty

#: Fixed patterns; possessive repeats and the look-behinds change no match, they keep the search
#: linear on long runs. Order is the order of kinds within equal starts.
SEEDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Marks the kind of what patterns discovered: "context_" and the kind of the seeds.
FOUND = "context_"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[\"'(<\[]*+(?=[^\x20\x09-\x0D]*[0-9@])[A-Za-z0-9+#@][^\x20\x09-\x0D]{4,}"
@dataclass(frozen=True)
class Settings:
    rounds: int | None = None  # None: until no confidence changes
    least_seeds: int = 3  # distinct seeds of a kind that a pattern must have
    confident: float = 0.8  # confidence from which a pattern vouches for its instances
    accept: float = 0.9  # score from which a candidate is an identifier
    trailing: str = r"[\"')>\].,;:!?]+$"  # not part of a candidate


#: Code points of the pieces that a text is cut into where spans are taken out of it.
PIECE = 1000
BLANKS = r"[\x20\x09-\x0D]+"


def _pieces(text: Column, kind: str, pattern: str) -> Column:
    """Structs of (kind, number, found, gap length, words before, words after) for every match. A context is made
    of the few gaps and matches next to a match, so a text costs in proportion to its length."""

    def of_gaps(found: Column):
        def near(gaps: Column):
            def made(flat: Column) -> Column:
                # One word before a match of three words is the third at most; a match is a word or more.
                def one(m: Column, i: Column) -> Column:
                    tail = [F.substring_index(F.get(flat, i - k), " ", -4) for k in range(3)]
                    before = F.concat_ws(" ", F.get(found, i - 3), tail[2], F.get(found, i - 2), tail[1], F.get(found, i - 1), tail[0])
                    after = F.concat_ws(" ", F.substring_index(F.get(flat, i + 1), " ", 2), F.get(found, i + 1))
                    return F.struct(
                        F.lit(kind).alias("kind"), i.alias("number"), m.alias("found"), F.length(F.get(gaps, i)).alias("gap"),
                        before.alias("before"), after.alias("after"),
                    )

                return F.transform(found, one)

            return let(F.transform(gaps, lambda g: F.regexp_replace(g, BLANKS, " ")), made)

        return let(F.split(text, pattern, -1), near)

    empty = F.array().cast("array<struct<kind: string, number: int, found: string, gap: int, before: string, after: string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, of_gaps(found)).otherwise(empty))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the check: every second digit from the right counts twice,
    less nine above nine."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _holds(kind: Column, found: Column) -> Column:
    """Whether a match of a kind passes its check."""
    parts = F.split(found, r"\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        parts, lambda p: F.lpad(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3), 3, "0") <= "255"
    )
    n = F.length(_digits(found))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", n.between(12, 19) & luhn(F.substring(_digits(found), 1, 19)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def spans(docs: DataFrame, trailing: str = Settings.trailing) -> DataFrame:
    """(key, row, kind, start, end, found, before, after) of all seeds and of the candidates that
    overlap none; ``docs`` has key, row and text. ``before`` ends with the three words before, ``after``
    begins with the one behind."""
    patterns = {**SEEDS, "candidate": CANDIDATE}

    def every(text: Column) -> Column:
        return F.concat(*(_pieces(text, k, p) for k, p in patterns.items()))

    found = docs.select("key", "row", F.explode_outer(let(text_or_empty(F.col("text")), every)).alias("p")).filter("p.kind IS NOT NULL")
    # One row for each match, numbered by kind: starts are sums over the matches before.
    each = found.select("key", "row", "p.*").distinct()
    place = Window.partitionBy("key", "row", "kind").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.sum(F.col("gap") + F.length("found")).over(place)
    placed = each.withColumn("end", ended.cast("int")).withColumn("start", F.col("end") - F.length("found"))
    # A candidate loses the marks around it.
    lead = F.length(F.regexp_extract("found", r"^[\"'(<\[]*", 0))
    tail = F.length(F.regexp_extract("found", trailing, 0))
    candidate = F.col("kind") == "candidate"
    trimmed = placed.withColumns({
        "start": F.when(candidate, F.col("start") + lead).otherwise(F.col("start")),
        "end": F.when(candidate, F.col("end") - tail).otherwise(F.col("end")),
        "found": F.when(candidate, F.regexp_replace(F.regexp_replace("found", trailing, ""), r"^[\"'(<\[]*", "")).otherwise(F.col("found")),
    })
    held = trimmed.filter(F.when(candidate, F.length("found") >= 5).otherwise(_holds(F.col("kind"), F.col("found"))))
    before = Window.partitionBy("key", "row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    # What follows is what comes before in the opposite order: frames that reach to the end are worked out anew for every row.
    after = Window.partitionBy("key", "row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    seed = ~candidate
    reach = F.max(F.when(seed, F.col("end"))).over(before)
    next_one = F.min(F.when(seed, F.col("start"))).over(after)
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(next_one >= F.col("end"), F.lit(True)))
    return held.withColumn("free", free).filter(seed | F.col("free")).select("key", "row", "kind", "start", "end", "found", "before", "after")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of a context, as strings; none where the words are missing."""
    words = F.filter(F.split(F.lower(F.regexp_replace(before, "[0-9]", "0")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    behind = F.filter(F.split(F.lower(F.regexp_replace(after, "[0-9]", "0")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def made(w: Column):
        def both(v: Column) -> Column:
            n = F.size(w)
            last = F.element_at(w, -1)
            return F.filter(
                F.array(
                    F.when(n >= 2, F.concat(F.lit("2 "), F.array_join(F.slice(w, F.greatest(n - 1, F.lit(1)), 2), " "))),
                    F.when(n >= 3, F.concat(F.lit("3 "), F.array_join(F.slice(w, F.greatest(n - 2, F.lit(1)), 3), " "))),
                    F.when((n >= 1) & (F.size(v) >= 1), F.concat_ws(" ", F.lit("b"), last, F.lit("_"), v[0])),
                ),
                lambda p: p.isNotNull(),
            )

        return let(behind, both)

    return let(words, made)


def score_instances(edges: DataFrame, seeds: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(instance, kind, score) of the candidates that confident patterns vouch for.

    ``edges`` has distinct (pattern, instance), ``seeds`` distinct (instance, kind). Sums are
    map-side combined and joins plain, so a pattern with very many instances is split by Spark."""
    # Only patterns that enough seeds of one kind share can ever be confident.
    seeded = edges.join(seeds, "instance")
    able = seeded.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds")).filter(F.col("n_seeds") >= settings.least_seeds)
    inner = cut_lineage(edges.join(able.select("pattern").distinct(), "pattern"))
    sizes = inner.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    asked = cut_lineage(able.join(sizes, "pattern"))
    known = seeds.withColumn("score", F.lit(1.0))
    scores = state = None
    for _ in count() if settings.rounds is None else range(settings.rounds):
        held = known if scores is None else known.unionByName(scores)
        sums = inner.join(held, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        trust = asked.join(sums, ["pattern", "kind"]).withColumn("confidence", F.col("total") / F.col("n"))
        if settings.rounds is None:
            # Confidences only rise, and to a bound.
            trust = cut_lineage(trust)
            mixed = F.xxhash64("pattern", "kind", F.round("confidence", 6))
            before, state = state, trust.agg(F.count(F.lit(1)), F.bit_xor(mixed)).first()
            if state == before:
                break
        trusted = trust.filter(F.col("confidence") >= settings.confident).select("pattern", "kind", "confidence")
        vouched = inner.join(trusted, "pattern").join(seeds.select("instance").distinct(), "instance", "left_anti")
        # A doubt of 0 is kept above 0 so that its logarithm is finite.
        doubt = F.log(F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-6)))
        scores = cut_lineage(vouched.groupBy("instance", "kind").agg((F.lit(1.0) - F.exp(F.sum(doubt))).alias("score")))
    return scores.filter(F.col("score") >= settings.accept)


def find_personal_data(docs: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(key, row, spans) for every row of ``docs``: an array of (start, place, kind, end) ordered by
    start, then by the kinds' order. ``row`` is ``row_key`` of the text."""
    rows = docs.select(F.col(key).alias("key"), row_key(F.col(text)).alias("row"), F.col(text).alias("text"))
    every = cut_lineage(spans(rows, settings.trailing))
    seeds = every.filter("kind <> 'candidate'").select(F.col("found").alias("instance"), "kind").distinct()
    context = every.select(F.col("found").alias("instance"), F.explode_outer(_patterns(F.col("before"), F.col("after"))).alias("pattern"))
    edges = cut_lineage(context.filter("pattern IS NOT NULL").distinct())
    accepted = score_instances(edges, seeds, settings)
    # The best kind of each instance; ties go to the first in the kinds' order.
    order = F.create_map(*(F.lit(x) for i, k in enumerate(SEEDS) for x in (k, i)))
    best = accepted.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), order[F.col("kind")])).alias("kind"))
    occurring = every.filter("kind = 'candidate'").select("key", "row", "start", "end", F.col("found").alias("instance"))
    discovered = occurring.join(best, "instance").select("key", "row", F.concat(F.lit(FOUND), "kind").alias("kind"), "start", "end")
    base = every.filter("kind <> 'candidate'").select("key", "row", "kind", "start", "end")
    kinds = [*SEEDS, *(FOUND + k for k in SEEDS)]
    placed = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))[F.col("kind")]
    made = (
        base.unionByName(discovered)
        .groupBy(F.col("key").alias("k"), F.col("row").alias("r"))
        .agg(F.array_sort(F.collect_list(F.struct("start", placed.alias("place"), "kind", "end"))).alias("spans"))
    )
    ids = rows.select("key", "row")
    joined = ids.join(made, ids["key"].eqNullSafe(made["k"]) & (ids["row"] == made["r"]), "left")
    none = F.array().cast("array<struct<start: int, place: int, kind: string, end: int>>")
    return joined.select(F.col("key").alias(key), "row", F.coalesce("spans", none).alias("spans"))


def _between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points ``a`` (from 0) to ``b`` of a text in pieces."""
    first, last = (a / PIECE).cast("int"), (b / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), a % PIECE + 1, F.lit(PIECE))
    tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), b % PIECE)
    inside = F.substring(F.get(pieces, first), a % PIECE + 1, b - a)
    across = F.concat(F.coalesce(head, F.lit("")), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(first == last, F.coalesce(inside, F.lit(""))).otherwise(across)


def redacted(text: Column, runs: Column) -> Column:
    """The text with every run (start, kind, end) replaced by its kind in angle brackets; runs are ordered and apart."""

    def made(pieces: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            since = F.coalesce(F.get(runs, i - 1)["end"], F.lit(0))
            return F.concat(_between(pieces, since, r["start"]), F.lit("<"), F.upper(r["kind"]), F.lit(">"))

        rest = _between(pieces, F.element_at(runs, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(runs, one), ""), rest)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0), made)


def _runs(found: DataFrame) -> DataFrame:
    """(span_key, span_row, runs): overlapping spans joined, with the kind of the first."""
    each = found.select("span_key", "span_row", F.posexplode("spans").alias("pos", "s"))
    order = Window.partitionBy("span_key", "span_row").orderBy("pos")
    reach = F.coalesce(F.max("s.end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = each.withColumn("fresh", (F.col("s.start") >= reach).cast("int")).withColumn("run", F.sum("fresh").over(order))
    runs = numbered.groupBy("span_key", "span_row", "run").agg(F.min("s.start").alias("start"), F.min_by("s.kind", "pos").alias("kind"), F.max("s.end").alias("end"))
    return runs.groupBy("span_key", "span_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("runs"))


def redact(docs: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with personal data replaced in ``text``; all other columns and rows as they are."""
    found = find_personal_data(docs, key, text, settings).filter(F.size("spans") > 0)
    made = found.select(F.col(key).alias("span_key"), F.col("row").alias("span_row"), "spans").dropDuplicates(["span_key", "span_row"])
    row, runs = free_name(docs, "row"), free_name(docs, "runs")
    made = _runs(made).withColumnRenamed("runs", runs)
    named = docs.withColumn(row, row_key(F.col(text)))
    joined = named.join(made, same_row(named, made, key, row, "span_key", "span_row"), "left")
    clean = F.when(F.col(runs).isNull(), F.col(text)).otherwise(redacted(F.col(text), F.col(runs)))
    return joined.select(*(clean.alias(c) if c == text else named[c] for c in docs.columns))
