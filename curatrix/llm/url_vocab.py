"""URL filter with a weighted vocabulary and host rules.

An Aho-Corasick automaton finds all terms of the vocabulary in a lower-cased url in one pass. A hit
counts only between word boundaries (a neighbour is no letter or digit of ``[a-z0-9]``). A url is
rejected on one strict term, or when at least two distinct soft terms together reach the limit. Host rules
come first: a rule names a host with all its subdomains and a path prefix, and the longest fitting
rule decides.

Defined results: a null url, or one without ``://``, has an empty host and path, so no rule fits;
the vocabulary still judges the whole string, and a null or empty one is allowed. Repeated rows
give repeated results; rules of equal length cannot both fit but by the same name, of which the first by name counts; very long urls take one linear pass; an
empty table gives no rows. Only the url column is read: ``filter_urls`` returns no other column than
the key, and ``judge_terms`` replaces columns that are called like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import LOWER, UPPER


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: Longest rule first is not needed: the longest fitting name wins.
RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)

STRICT = ("spam-farm", "cheap-pills", "xxx", "porn", "viagra", "casino", "malware", "phishing")
#: Soft terms with their weights; their distinct weights are added up.
SOFT = {
    "cheap": 1, "pills": 1, "spam": 1, "farm": 1, "free": 1, "win": 1, "bonus": 1, "loan": 1,
    "download": 1, "click": 1, "betting": 2, "escort": 2, "replica": 2, "lottery": 2,
}
LIMIT = 2
#: Distinct soft terms without which no weight rejects.
LEAST_SOFT = 2
FOUND = ("strict_hits", "soft_hits", "soft_weight", "term_verdict")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> Column:
    """A struct of the longest fitting rule's name and verdict, else null."""
    fits = []
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        ours = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        said = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits.append(F.when(ours & F.startswith(path, F.lit(r.path)), said))
    return F.coalesce(*fits)


def hits(automaton, text: str) -> set[str]:
    """Distinct terms of the automaton that stand between word boundaries."""
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    found = set()
    for last, term in automaton.iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in word) and (last + 1 == len(text) or text[last + 1] not in word):
            found.add(term)
    return found


def build(terms) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return automaton


def judge_terms(rows: DataFrame, url: str, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``strict_hits``, ``soft_hits`` (sorted distinct terms), ``soft_weight`` and
    ``term_verdict``."""
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in FOUND))
    schema, names = rows.schema, rows.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build({*strict, *soft})
        lower = str.maketrans(UPPER, LOWER)
        hard = set(strict)
        for batch in batches:
            found = [sorted(hits(automaton, (u or "").translate(lower))) for u in batch.column(names.index(url)).to_pylist()]
            firm = [[t for t in f if t in hard] for f in found]
            weak = [[t for t in f if t in soft] for f in found]
            weight = [sum(soft[t] for t in w) for w in weak]
            said = ["block" if f or (len(s) >= LEAST_SOFT and w >= limit) else "allow" for f, s, w in zip(firm, weak, weight, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(firm, pa.list_(pa.string())), pa.array(weak, pa.list_(pa.string())), pa.array(weight, pa.int32()), pa.array(said, pa.string())],
                [*names, *FOUND],
            )

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(judge, out + ", strict_hits array<string>, soft_hits array<string>, soft_weight int, term_verdict string")


def filter_urls(pages: DataFrame, key: str, url: str, rules: tuple[HostRule, ...] = RULES, **vocabulary) -> DataFrame:
    """key, host, path, rule, verdict, and what the vocabulary found."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    judged = judge_terms(rows, "url", **vocabulary)
    parted = judged.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parted.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    return ruled.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "term_verdict").alias("verdict"),
        "strict_hits",
        "soft_hits",
        "soft_weight",
    )
