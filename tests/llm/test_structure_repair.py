"""Structure repair beside plain dynamic programming over whole strings, and its bounded memory."""

import hashlib
import random
import re

import pytest

from curatrix.llm import structure_repair as R

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """The report of one conversation's (turn, role, text) rows."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", hashlib.sha256((r[2] or "").encode()).digest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        t = (text or "").rstrip(BLANK)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {("", ""): (0, "")}  # (automaton state, not used) -> (cost, edits)
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(now):
        for _ in range(3):
            for (state, _), (cost, edits) in list(now.items()):
                for c in "ua":
                    if (state, c) in nexts:
                        to, made = (nexts[state, c], ""), (cost + 2, edits + "I")
                        now[to] = min(now.get(to, made), made)
        return now

    for (_, role, _), fault in zip(rows, faults, strict=True):
        out = {}

        def put(state, cost, edits, out=out):
            out[state, ""] = min(out.get((state, ""), (cost, edits)), (cost, edits))

        for (state, _), (cost, edits) in inserted(dict(best)).items():
            put(state, cost + 3, edits + "D")
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                for c, more, letter in (((role or "")[:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")):
                    if (state, c) in nexts:
                        put(nexts[state, c], cost + more + cut, edits + letter)
        best = out
    cost, audit = min(v for (state, _), v in inserted(dict(best)).items() if state in ("", "a"))
    kept = [e for e in audit if e != "D"]
    left, lines, at = iter(rows), [], 0
    for e in audit:
        row = None if e == "I" else next(left)
        if e != "D":
            at += 1
            role = (row[1] or "") if e == "K" else "user" if (at + len(kept)) % 2 else "assistant"
            lines.append(f"{role}:{(row[2] or '') if row else ''}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = {r[0] for r in rows} - {None}
    initials = [(r[1] or "")[:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def reported(spark, rows, turn="long"):
    table = spark.createDataFrame([(*r, "x") for r in rows], f"conv long, turn {turn}, role string, text string, part string")
    made = R.report(R.in_order(R.faulty(table, "conv", "turn", "role", "text"))).collect()
    return {r["conv"]: tuple(r)[1:] for r in made}


def drawn(r, n, roles, texts, turns):
    return [(r.choice(turns), r.choice(roles), r.choice(texts)) for _ in range(n)]


def test_equals_plain_loops(spark):
    r = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "supervisor", "User"]
    texts = ["Fine.", "well?", "cut off", "", " \t\n", None, "no end ", "yes! \r", "a.b"] + [f"text {i}." for i in range(30)]
    every = {}
    for conv in range(60):
        every[conv] = drawn(r, r.randrange(1, 12), roles[:3] if conv % 2 else roles, texts, [None, *range(9)])
    # Long enough to lie in several partitions, with all kinds of ties.
    every[None] = drawn(r, 400, roles, texts, [None, *range(150)])
    every[1000] = [(i, "u" * (i % 3) or "tool", f"open {i}") for i in range(300)]
    every[1001] = [(i, "user", f"cut {i}") for i in range(300)] + [(301, "system", "Late."), (302, "user", "Q?"), (303, "assistant", "A.")]
    made = reported(spark, [(c, *row) for c, rows in every.items() for row in rows])
    assert set(made) == set(every)
    for conv, rows in every.items():
        assert made[conv] == plain(rows), conv


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(6)
    rows = [(7, i // 2, r.choice(["user", "assistant", "system"]), r.choice(["One.", "two", f"Row {i}."])) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
        ordered = R.in_order(R.faulty(table, "conv", "turn", "role", "text"))
        assert ordered.select("part").distinct().count() > 5
        between = R.states_between(ordered)
        assert between.count() == ordered.select("part").distinct().count()
        assert [tuple(x)[1:] for x in R.report(ordered).collect()] == [plain([x[1:] for x in rows])]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_and_very_long(spark):
    assert reported(spark, []) == {}
    long = "word " * 400_000
    rows = [(0, "user", long), (1, "assistant", long), (2, "user", long + "."), (3, "assistant", long + "!")]
    assert reported(spark, [(1, *x) for x in rows])[1] == plain(rows)


@pytest.mark.parametrize("roles", ["uaua", "ssss", "uuuu", "tttt"])
def test_unresolved_rows_stay_few(roles):
    def nodes(node):
        return 1 + sum(nodes(k) for k in node.kids)

    survivors = R.Survivors()
    for i in range(20_000):
        survivors.step(roles[i % 4] if i % 100 else "s", i % 37 == 0, i % 5 == 0)
        if i % 500 == 0:
            assert nodes(survivors.root) < 400  # an "s" comes every 100 rows; its place is open until the next


def test_split_anywhere_gives_the_same_edits():
    r = random.Random(8)
    for _ in range(200):
        rows = [(r.choice(["u", "a", "s", "t", ""]), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randrange(1, 25))]
        whole = R.Survivors()
        edits = [e for row in rows for e in whole.step(*row)]
        left, tail = whole.finish()
        want = "".join([*edits, *left, tail])
        cuts = sorted(r.sample(range(len(rows)), min(len(rows), 3)))
        pieces = [p for p in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)) if p]
        tables = []
        for piece in pieces:
            each = [R.Survivors(e) for e in range(4)]
            for row in piece:
                for s in each:
                    s.step(*row)
            tips = [s.tips.get(x) for s in each for x in range(4)]
            tables.append(([t[0] if t else R.FAR for t in tips], [t[1] if t else 0 for t in tips]))
        got = ""
        for piece, (entry, leave) in zip(pieces, R.fold(tables), strict=True):
            s = R.Survivors(entry)
            got += "".join(e for row in piece for e in s.step(*row))
            left, tail = s.finish(leave)
            got += "".join(left) + tail
        assert got == want
