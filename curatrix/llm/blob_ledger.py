"""Secret scan with an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its text). A ledger holds
one row per scanned pair of blob and rule version; a run scans only the pairs that the ledger
lacks, each blob once however many paths or versions hold it, and joins the findings of all blobs
back to all paths.

Defined results: a null text is the empty blob; a null path or version is a path like any other;
repeated rows each get their findings; an empty table gives empty results; very long texts are scanned in one
linear pass a rule; other columns pass through, and one that is called like the new column is replaced. A rule that changes gets a new version and is then scanned
again; findings of old versions stay in the ledger and are not reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import free_name, text_or_empty

LEDGER = (
    "blob string, rule string, rule_version int, spans array<struct<start: int, end: int>>"
)


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, leftmost and non-overlapping, are secrets if ``group`` has at
    least ``least`` characters. Patterns must be linear: no nested repeats."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


#: Order is the order of kinds within equal starts. The first three are the base kinds.
RULES = (
    Rule(
        "assign",
        1,
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
        r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]+", least=24),
    Rule("jwt", 2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", least=30),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    found = re.finditer(rule.pattern, text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("blob", pa.string()),
                ("rule", pa.string()),
                ("rule_version", pa.int32()),
                ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            ]
        )
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("blob", "text", "unseen"))
            for blob, text, unseen in zip(*columns, strict=True):
                for name in unseen:
                    spans = [{"start": a, "end": b} for a, b in spans_of(by_name[name], text)]
                    out.append({"blob": blob, "rule": name, "rule_version": by_name[name].version, "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def blob_id(text) -> F.Column:
    return F.sha2(text_or_empty(text), 256)


def scan_unseen(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one per unseen pair of a blob of ``versions`` and a rule version.

    Append them to the ledger table. A pair without findings is a row as well, with no spans.
    Copies meet in a map-side combined aggregate, so a blob that a third of all rows hold crosses
    the network once per task."""
    named = versions.select(blob_id(F.col(text)).alias("blob"), text_or_empty(F.col(text)).alias("text"))
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = named.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        asked = blobs.withColumn("unseen", names)
    else:
        current = " OR ".join(f"(rule = '{r.name}' AND rule_version = {r.version})" for r in rules)
        seen = ledger.filter(current).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        none = F.array().cast("array<string>")
        asked = (
            blobs.join(seen, "blob", "left")
            .select("blob", "text", F.array_except(names, F.coalesce("seen", none)).alias("unseen"))
            .filter(F.size("unseen") > 0)
        )
    return asked.mapInArrow(_scanner(rules), LEDGER)


def findings(versions: DataFrame, text: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found_spans") -> DataFrame:
    """``versions`` without its text, with ``into``: spans ordered by start, then
    by the order of the rules, from the ledger rows of the rules' current versions."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    current = " OR ".join(f"(rule = '{r.name}' AND rule_version = {r.version})" for r in rules)
    kept = [c for c in versions.columns if c not in (text, into)]
    blob, theirs, spans = free_name(versions, "blob"), free_name(versions, "found_blob"), free_name(versions, "spans")
    per_blob = (
        ledger.filter(current)
        .filter(F.size("spans") > 0)
        .dropDuplicates(["blob", "rule"])
        .select("blob", "rule", F.inline("spans"))
        .groupBy(F.col("blob").alias(theirs))
        .agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("place"), F.col("rule").alias("kind"), "end"))).alias(spans))
    )
    none = F.array().cast("array<struct<start: int, place: int, kind: string, end: int>>")
    held = versions.select(*(F.col(f"`{c}`") for c in kept), blob_id(F.col(text)).alias(blob))
    joined = held.join(per_blob, F.col(blob) == F.col(theirs), "left")
    return joined.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(spans, none).alias(into))
