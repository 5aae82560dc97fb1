"""Conversation structure repair by Viterbi decoding with survivor coalescence.

Rows of a conversation, in the order of (turn, role, SHA-256 of the text), nulls first, are edited at the least cost until
the initials of their roles read ``(s?(ua)+)?``: Keep 0, Rerole 2, Delete 3 (the only choice for
blank and duplicate rows), Insert 2, and 1 for each truncated row that stays. Of equally cheap
edits the ASCII-least string of initials wins.

Survivors are the best edits into each of four states (nothing yet, s, u, a). They are the tips of a tree
of backpointers with reference counts: a node that no survivor reaches is freed, and once all
survivors share an ancestor the edits up to it are emitted and forgotten. Ties compare the complete
unresolved suffixes; their order is kept as ranks of the tips, so a tie costs the same however long the
suffixes are. A survivor that another one beats whatever follows is dropped: only so do survivors that
delete everything ever meet the others.

No task needs a whole conversation. Rows are range partitioned in order; a conversation that lies in
several partitions is first summed up per partition (cost and order of the best edits from each
state to each other), the few summaries are folded in order, and every partition is then decoded
between its known states. Memory is bounded by the unresolved rows of one partition.

Defined results: a null role, text, or turn is a value like any other, as is a null conversation
id; a role is known by its first character, an empty role has none and cannot be kept; equal rows
each count, all but the first as duplicates; very long texts pass through one at a time; an empty table gives no rows;
only the four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 60


def _moves(initial: str) -> list[tuple[int, str, int, int]]:
    """(from, edits, to, cost) of keeping or reroling a row, with the inserts that must precede it."""
    out = [(NONE, "K", SYSTEM, 0)] if initial == "s" else []
    for letter, cost, to in (("K", 0, STATE.get(initial)), ("R", REROLE, USER), ("R", REROLE, ASSISTANT)):
        if to == USER:
            out += [(x, letter, USER, cost) for x in (NONE, SYSTEM, ASSISTANT)] + [(USER, "I" + letter, USER, cost + INSERT)]
        elif to == ASSISTANT:
            out += [(x, "I" + letter, ASSISTANT, cost + INSERT) for x in (NONE, SYSTEM, ASSISTANT)] + [(USER, letter, ASSISTANT, cost)]
    return out


MOVES = {c: _moves(c) for c in ("s", "u", "a", "")}
#: (state, edits, cost) that end a conversation.
ENDS = ((NONE, "", 0), (ASSISTANT, "", 0), (USER, "I", INSERT), (SYSTEM, "II", 2 * INSERT))


class Node:
    """One row's edits on a path; ``refs`` counts its children and the survivor at it."""

    __slots__ = ("edits", "kids", "parent", "refs")

    def __init__(self, parent: Node | None, edits: str) -> None:
        self.parent, self.edits, self.kids, self.refs = parent, edits, [], 0


class Survivors:
    """The best edits into each state, from ``entry`` on."""

    def __init__(self, entry: int = NONE) -> None:
        self.root = Node(None, "")
        self.root.refs = 1
        #: state -> (cost, rank of its complete edits, node).
        self.tips: dict[int, tuple[int, int, Node]] = {entry: (0, 0, self.root)}

    def step(self, initial: str, delete_only: bool, truncated: bool) -> list[str]:
        """Takes one row; gives the edits, by row, on which all survivors now agree."""
        best: dict[int, tuple[int, int, str, Node]] = {}
        for state, (cost, rank, node) in self.tips.items():
            best[state] = (cost + DELETE, rank, "D", node)
        if not delete_only:
            for before, edits, after, more in MOVES.get(initial, MOVES[""]):
                tip = self.tips.get(before)
                if tip is not None:
                    made = (tip[0] + more + truncated, tip[1], edits, tip[2])
                    if after not in best or made[:3] < best[after][:3]:
                        best[after] = made
        none, kept = best.get(NONE), best.get(ASSISTANT)
        if kept:
            # Whatever follows "nothing yet" can follow "a" at a cost of at most one more Delete.
            if none and kept[0] + DELETE < none[0]:
                del best[NONE]
            if SYSTEM in best and kept[:3] < best[SYSTEM][:3]:
                del best[SYSTEM]
            if none and none[:3] < kept[:3]:
                del best[ASSISTANT]
        old = [node for _, _, node in self.tips.values()]
        order = sorted(best, key=lambda s: best[s][1:3])
        self.tips = {}
        for rank, state in enumerate(order):
            cost, _, edits, parent = best[state]
            node = Node(parent, edits)
            node.refs = 1
            parent.kids.append(node)
            parent.refs += 1
            self.tips[state] = (cost, rank, node)
        for node in old:
            self._release(node)
        return self._agreed()

    def _release(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node.parent = None
            node = parent

    def _agreed(self) -> list[str]:
        out = []
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.edits)
        return out

    def finish(self, exit_state: int | None = None) -> tuple[list[str], str]:
        """The edits left, by row, and those behind the last row; at the cheapest end, or in a state."""
        if exit_state is not None:
            node, tail = self.tips[exit_state][2], ""
        else:
            state, tail = cheapest_end({s: t[:2] for s, t in self.tips.items()})
            node = self.tips[state][2]
        out = []
        while node is not self.root:
            out.append(node.edits)
            node = node.parent
        return out[::-1], tail


def cheapest_end(tips: dict[int, tuple[int, int]]) -> tuple[int, str]:
    """(state, edits behind the last row) for states with (cost, rank)."""
    return min((tips[s][0] + more, tips[s][1], s, edits) for s, edits, more in ENDS if s in tips)[2:]


def faulty(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, mark, fault): the first fault of blank, duplicate and truncated, else
    an empty string. Copies that share a turn too are left to ``repair``, where they are neighbours."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    # The hexadecimal role has no colon; a null is written as one that no value can be written as.
    parts = F.coalesce(F.hex("role"), F.lit("null")), F.lit(":"), F.col("text").isNull().cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))
    mark = F.sha2(F.concat(*parts), 256)
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    marked = named.withColumn("mark", F.unhex(mark))
    # The first turn of every row that occurs more than once; nulls come first.
    first = (
        marked.groupBy(F.col("conv").alias("c"), F.col("mark").alias("m"))
        .agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("c", "m", F.col("first.turn").alias("first"))
    )
    both = marked.join(first, marked["conv"].eqNullSafe(first["c"]) & (marked["mark"] == first["m"]), "left")
    later = F.col("c").isNotNull() | F.col("m").isNotNull()
    blank = F.coalesce(trimmed, F.lit("")) == ""
    fault = (
        F.when(blank, "blank")
        .when(later & ~F.col("turn").eqNullSafe(F.col("first")), "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    return both.select("conv", "turn", "role", "text", "mark", fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """``faulty`` rows in order over all partitions, with the number of theirs (``part``), stored."""
    keyed = rows.withColumn("text_sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    by = [*(F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")), F.col("text_sha"), F.col("mark")]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("text_sha")
    return cut_lineage(dealt.withColumn("part", F.spark_partition_id()))


def spanning(ordered: DataFrame) -> DataFrame:
    """(conv) of the conversations in several partitions: they hold an end of one, so there are fewer
    than two a partition."""
    ends = ordered.groupBy("part").agg(F.min(F.struct(F.col("conv").isNotNull(), "conv")).alias("a"), F.max(F.struct(F.col("conv").isNotNull(), "conv")).alias("b"))
    held = ends.select("part", F.explode(F.array("a.conv", "b.conv")).alias("conv"))
    return held.groupBy("conv").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("conv")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows as tuples, with whether the conversation begins and whether the row equals the last one."""
    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            for row in zip(*(some.column(n).to_pylist() for n in names), strict=True):
                here = row[:4]
                yield last is None or here[0] != last[0], here == last, row
                last = here


FIRST = ("conv", "turn", "mark", "role", "fault", "part")
SUMMARY = "conv {}, part int, costs array<long>, ranks array<long>, first_turn {}, last_turn {}, last_initial string"


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation of a partition: costs and ranks of the best edits by (entry, exit)."""
    held: list = []

    def made() -> pa.RecordBatch:
        conv, part, entries, first, turn, initial = held
        tips = [e.tips.get(x) for e in entries for x in range(4)]
        row = {"conv": conv, "part": part, "costs": [t[0] if t else FAR for t in tips], "ranks": [t[1] if t else 0 for t in tips]}
        return pa.RecordBatch.from_pylist([row | {"first_turn": first, "last_turn": turn, "last_initial": initial}], schema)

    for new, again, (conv, turn, _, role, fault, part) in _runs(batches, FIRST):
        if new:
            if held:
                yield made()
            held = [conv, part, [Survivors(e) for e in range(4)], turn, turn, ""]
        initial = (role or "")[:1]
        gone = fault in ("blank", "duplicate") or again
        for e in held[2]:
            e.step(initial, gone, fault == "truncated")
        held[4:] = [turn, initial]
    if held:
        yield made()


def fold(segments: list[tuple[list[int], list[int]]]) -> list[tuple[int, int | None]]:
    """(entry, exit) state of each segment of a conversation, from (costs, ranks) by entry and exit;
    the last one's exit is open."""
    tips: dict[int, tuple[int, int]] = {NONE: (0, 0)}
    back = []
    for costs, ranks in segments:
        best: dict[int, tuple[int, int, int, int]] = {}
        for e, (cost, rank) in tips.items():
            for x in range(4):
                if costs[4 * e + x] < FAR:
                    now = (cost + costs[4 * e + x], rank, ranks[4 * e + x], e)
                    if x not in best or now[:2] < best[x][:2]:
                        best[x] = now
        order = sorted(best, key=lambda x: best[x][1:3])
        tips = {x: (best[x][0], n) for n, x in enumerate(order)}
        back.append({x: b[3] for x, b in best.items()})
    state, out = cheapest_end(tips)[0], []
    for number, step in enumerate(reversed(back)):
        out.append((step[state], state if number else None))
        state = step[state]
    return out[::-1]


def states_between(ordered: DataFrame) -> DataFrame:
    """(conv, part, entry, exit, turn_before, initial_before) of the partitions of conversations that
    lie in several; fewer than two rows a partition."""
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    some = ordered.join(F.broadcast(spanning(ordered).withColumnRenamed("conv", "c")), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    told = SUMMARY.format(kinds["conv"], kinds["turn"], kinds["turn"])
    arrow = pa.schema([("conv", _arrow(kinds["conv"])), ("part", pa.int32()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
                       ("first_turn", _arrow(kinds["turn"])), ("last_turn", _arrow(kinds["turn"])), ("last_initial", pa.string())])
    summed = some.select(*FIRST).mapInArrow(lambda batches: _summaries(batches, arrow), told)

    def folded(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("part")
        states = fold(list(zip(rows["costs"].map(list), rows["ranks"].map(list), strict=True)))
        before = rows["last_turn_text"].shift(1), rows["last_initial"].shift(1)
        return pd.DataFrame({
            "conv_text": rows["conv_text"], "part": rows["part"], "entry": [e for e, _ in states], "exit_state": [-1 if x is None else x for _, x in states],
            "turn_before": before[0], "initial_before": before[1],
        })

    texts = summed.select(F.col("conv").cast("string").alias("conv_text"), "part", "costs", "ranks", F.col("last_turn").cast("string").alias("last_turn_text"), "last_initial")
    made = texts.groupBy("conv_text").applyInPandas(folded, "conv_text string, part int, entry int, exit_state int, turn_before string, initial_before string")
    return made.select(F.col("conv_text").cast(kinds["conv"]).alias("conv"), "part", "entry", "exit_state", "turn_before", "initial_before")


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in known:
        raise TypeError(f"conversation ids and turns are integers or strings, not {kind}")
    return known[kind]


SECOND = (*FIRST, "text", "entry", "exit_state", "turn_before", "initial_before")
EDITS = "conv {}, part int, place long, edit string, fault string, illegal boolean, new_turn boolean, turn {}, role string, text string, cost int"


def _decoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per edit."""
    out: list[dict] = []
    size = 0
    survivors, pending, state, place, end = None, deque(), NONE, 0, None

    def edited(edits: str, row: dict | None) -> None:
        nonlocal state, place, size
        for letter in edits:
            one = {"conv": end[0], "part": end[1], "place": place, "edit": letter, "fault": "", "illegal": False, "new_turn": False, "turn": None, "role": None, "text": "", "cost": 0}
            place += 1
            if letter != "I":
                one |= row
                if letter != "D" and row["fault"] == "truncated":
                    one["cost"] = TRUNCATED
            if letter in "IR":
                state = ASSISTANT if state == USER else USER
                one["role"] = ROLE[state]
            elif letter == "K":
                state = STATE[row["role"][:1]]
            one["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
            size += len(one["text"] or "")
            out.append(one)

    def close() -> None:
        if survivors is not None:
            rows, tail = survivors.finish(end[2])
            for edits in rows:
                edited(edits, pending.popleft())
            edited(tail, None)

    seen_turn = last_initial = None
    for new, again, (conv, turn, _, role, fault, part, text, entry, leave, turn_before, initial_before) in _runs(batches, SECOND):
        if new:
            close()
            begins = entry is None or initial_before is None
            survivors, pending, state, place = Survivors(entry or NONE), deque(), entry or NONE, 0
            end = (conv, part, None if leave is None or leave < 0 else leave)
            seen_turn = None if begins else turn_before
            last_initial = None if begins else initial_before
        initial = (role or "")[:1]
        if again and fault != "blank":
            fault = "duplicate"
        fresh = turn is not None and str(turn) != seen_turn
        pending.append({
            "fault": fault, "turn": turn, "role": role, "text": text, "new_turn": fresh,
            "illegal": last_initial is not None and last_initial + initial not in ("su", "ua", "au"),
        })
        seen_turn, last_initial = None if turn is None else str(turn), initial
        for edits in survivors.step(initial, fault in ("blank", "duplicate"), fault == "truncated"):
            edited(edits, pending.popleft())
        if len(out) >= 4096 or size > 4_000_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(ordered: DataFrame) -> DataFrame:
    """All edits of the rows that ``in_order`` gave, one row each, ordered by (conv, part, place):
    edit (K, R, D or I), fault of the row, whether it and the row before it have illegal initials, whether its turn is new,
    the repaired role and the text (those of a deleted row are still there), and the edit's cost."""
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    between = cut_lineage(states_between(ordered)).withColumnsRenamed({"conv": "c", "part": "p"})
    # Fewer than two rows of some fifty bytes a partition.
    known = ordered.join(F.broadcast(between), F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    schema = pa.schema([("conv", _arrow(kinds["conv"])), ("part", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()),
                        ("new_turn", pa.bool_()), ("turn", _arrow(kinds["turn"])), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int32())])
    return known.select(*SECOND).mapInArrow(lambda batches: _decoded(batches, schema), EDITS.format(kinds["conv"], kinds["turn"]))


REPORT = "conv {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _reported(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, out = None, []

    def made() -> dict:
        faults = held["faults"]
        gaps = held["most"] - held["least"] + 1 - held["turns"] if held["turns"] else 0
        return {"conv": held["conv"], "gaps": gaps, "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
                "illegal": held["illegal"], "cost": held["cost"], "audit": "".join(held["audit"]), "repaired_sha256": held["sha"].hexdigest()}

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for r in batch.slice(at, 1024).to_pylist():
                if held is None or held["conv"] != r["conv"]:
                    if held:
                        out.append(made())
                    held = {"conv": r["conv"], "faults": {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}, "illegal": 0, "cost": 0,
                            "audit": [], "sha": hashlib.sha256(), "any": False, "turns": 0, "least": 0, "most": 0}
                held["faults"][r["fault"]] += 1
                held["illegal"] += r["illegal"]
                held["cost"] += r["cost"]
                held["audit"].append(r["edit"])
                if len(held["audit"]) > 4096:
                    held["audit"] = ["".join(held["audit"])]
                if r["new_turn"]:
                    held["least"], held["most"] = (min(held["least"], r["turn"]), max(held["most"], r["turn"])) if held["turns"] else (r["turn"], r["turn"])
                    held["turns"] += 1
                if r["edit"] != "D":
                    held["sha"].update(b"\n" * held["any"] + f"{r['role'] or ''}:".encode())
                    held["sha"].update((r["text"] or "").encode())
                    held["any"] = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if held:
        yield pa.RecordBatch.from_pylist([made()], schema)


def report(ordered: DataFrame) -> DataFrame:
    """One row per conversation: gaps between integer turns, faults, illegal neighbours, cost, audit
    (the edits' letters) and the SHA-256 of the repaired ``role:text`` rows, joined by line feeds.

    A conversation within one partition is summed up where it lies. Those in several, at most one a
    partition boundary, are brought together in order: a digest has to be fed in order, and is fed as a
    stream that holds one row at a time."""
    kind = ordered.schema["conv"].dataType.simpleString()
    schema = pa.schema([("conv", _arrow(kind)), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    wide = cut_lineage(spanning(ordered)).withColumnRenamed("conv", "c")
    edits = repair(ordered)

    def summed(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _reported(batches, schema), REPORT.format(kind))

    same: Column = F.col("conv").eqNullSafe(F.col("c"))
    here = edits.join(F.broadcast(wide), same, "left_anti")
    there = edits.join(F.broadcast(wide), same, "left_semi").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "place")
    return summed(here).unionByName(summed(there))
