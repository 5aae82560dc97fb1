import random
import re

import brute
import duckdb
import pytest

from curatrix.llm import blob_ledger as B
from curatrix.llm import pii_bootstrap as P
from curatrix.llm import queries
from curatrix.llm import url_vocab as U

KEY = "AKIA" + "ABCDEFGHIJKLMNOP1"
TEXTS = [
    None, "", f'x token = "{"a1" * 14}" y', f"Password:'abcdef' {KEY}{KEY}", "secret=abc api_key: qwertz12 APIKEY=zzzzzzz",
    "é" * 3 + " " + "0" * 24 + "g" + "f" * 23, "-----BEGIN RSA " + "PRIVATE KEY-----", "toKen=toKen=abcdef", "ſecret=abcdef paſsword=abcdefg", "passwd : " + "x" * 100000,
]


def secrets(text):
    out = []
    for place, rule in enumerate(B.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), place, rule.name, m.end()))
    return sorted(out)


def versions(spark, rows):
    return spark.createDataFrame([(i, n, t, "b", "r") for i, n, t in rows], "path long, version int, text string, blob string, rule string")


def test_ledger_scans_each_pair_once(spark):
    first = versions(spark, [(i, 0, t) for i, t in enumerate(TEXTS)] + [(50, 0, TEXTS[3]), (50, 0, TEXTS[3])])
    ledger = B.scan_unseen(first, "text").cache()
    blobs = {brute.sha(t or "") for t in TEXTS}
    assert ledger.count() == len(blobs) * len(B.RULES)
    assert B.scan_unseen(first, "text", ledger).count() == 0
    found = {(r["path"], tuple((s["start"], s["place"], s["kind"], s["end"]) for s in r["found_spans"])) for r in B.findings(first, "text", ledger).collect()}
    assert found == {(i, tuple(secrets(t))) for i, t in enumerate(TEXTS)} | {(50, tuple(secrets(TEXTS[3])))}
    # A later version of a path adds one blob; a changed rule is scanned again for all.
    later = first.unionByName(versions(spark, [(3, 1, "token=brandnew1"), (None, None, "token=brandnew1")]))
    more = B.scan_unseen(later, "text", ledger).cache()
    assert more.count() == len(B.RULES)
    changed = tuple(B.Rule(r.name, 2, r.pattern, r.group, 8) if r.name == "assign" else r for r in B.RULES)
    again = B.scan_unseen(later, "text", ledger.unionByName(more), changed).cache()
    assert {(r["rule"], r["rule_version"]) for r in again.collect()} == {("assign", 2)} and again.count() == len(blobs) + 1
    now = B.findings(later, "text", ledger.unionByName(more).unionByName(again), changed).filter("path IS NULL").first()
    assert [(s["kind"], s["start"], s["end"]) for s in now["found_spans"]] == [("assign", 0, 15)]


def test_empty_tables_of_versions(spark):
    none = versions(spark, [])
    ledger = B.scan_unseen(none, "text")
    assert ledger.count() == 0 and B.findings(none, "text", ledger).count() == 0


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/com/", "", "", None, "allow"),
        ("http://A.EXAMPLE.com/en/x?y", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("http://com", "com", "", None, "allow"),
        ("http://a.net/es/#x", "a.net", "/es/", "net/es/", "block"), ("http://a.net/ES/", "a.net", "/ES/", None, "allow"),
        ("http://a.org/casino", "a.org", "/casino", None, "block"), ("http://a.org/casinos", "a.org", "/casinos", None, "allow"),
        ("http://a.org/free", "a.org", "/free", None, "allow"), ("http://a.org/free-free", "a.org", "/free-free", None, "allow"),
        ("http://a.org/free/WIN", "a.org", "/free/WIN", None, "block"), ("x://y://z/casino", "y:", "//z/casino", None, "block"),
        ("http://spam-farm.org?xxxl", "spam-farm.org", "", None, "block"), ("http://o.org/\n/é-xxx é", "o.org", "/\n/é-xxx é", None, "block"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h")], "page_id long, url string, host string")
    rows = U.filter_urls(pages, "page_id", "url").collect()
    assert [tuple(r)[:5] for r in rows] == [(1, host, path, rule, verdict)] * 2


def test_vocabulary_equals_patterns():
    automaton = U.build({*U.STRICT, *U.SOFT})
    for text in ("cheap-pills", "cheap pills-free.win", "xxx-xxx", "spam-farm", "aspam farm1", "porn/porn", ""):
        assert U.hits(automaton, text) == {t for t in {*U.STRICT, *U.SOFT} if re.search(f"(?<![a-z0-9]){t}(?![a-z0-9])", text)}


SAMPLES = [
    None, "", "mail a.b@c.d and x@y.z.w_q@r.s a@b", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.002.0255.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (626) 555-5759. +12 +1234567890123456", "é +44 20 7946 0958 x 5500 0000 0000 0004", "a..b@c.d..e@f.g " + "z" * 20000, "4" * 6000, "1 " * 3000, "@ . + 1",
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "r", "k") for i, t in rows], "doc_id long, text string, spans string, row string, kind string")


def test_base_kinds_equal_loops(spark):
    rows = [*enumerate(SAMPLES), (3, SAMPLES[3]), (None, SAMPLES[4])]
    made = P.find_personal_data(docs_of(spark, rows), "doc_id", "text").collect()
    got = sorted((str(r["doc_id"]), [(s["start"], s["place"], s["kind"], s["end"]) for s in r["spans"]]) for r in made)
    assert got == sorted((str(i), brute.personal(t or "")) for i, t in rows)


def test_patterns_discover_identifiers(spark):
    seeds = [(i, f"word{i} please call my number {'+1 (626) 555-57' + str(10 + i)} soon") for i in range(6)]
    others = [(20 + i, f"other{i} please call my number X-77{i}41 today") for i in range(3)]
    plain = [(40 + i, f"in room X-99{i}00 we met") for i in range(3)] + [(60, "please call my number later")]
    made = {r["doc_id"]: r["spans"] for r in P.find_personal_data(docs_of(spark, seeds + others + plain), "doc_id", "text", P.Settings(confident=0.6)).collect()}
    assert all(["phone"] == [s["kind"] for s in made[i]] for i, _ in seeds)
    for i, t in others:
        assert [(s["kind"], t[s["start"] : s["end"]]) for s in made[i]] == [("context_phone", t.split()[5])]
    assert all(made[i] == [] for i, _ in plain)


def test_redaction(spark):
    rows = [*enumerate(SAMPLES), (None, SAMPLES[4])]
    made = P.redact(docs_of(spark, rows), "doc_id", "text")
    assert made.columns == ["doc_id", "text", "spans", "row", "kind"]
    want = sorted((str(i), None if t is None else brute.redacted(t, brute.personal(t))) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in made.collect()) == want
    assert P.redact(docs_of(spark, []), "doc_id", "text").count() == 0


def test_native_plan(spark):
    plan = P.find_personal_data(docs_of(spark, []), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("settings", [P.Settings(), P.Settings(confident=0.6, accept=0.6, least_seeds=2), P.Settings(rounds=1, confident=0.5, accept=0.5)])
def test_bootstrapping_equals_loops(spark, settings):
    r = random.Random(11)
    leads = ["please call my number", "write to me at", "the card on file", "from the host", "see page", "id no"]
    seeds = [lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", lambda: f"a{r.randrange(99)}@b{r.randrange(9)}.org", lambda: "4111 1111 1111 1111", lambda: f"10.0.{r.randrange(9)}.{r.randrange(255)}"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(1, 5)):
            k = r.randrange(len(leads))
            odd = f"({r.choice('XYZ')}-{r.randrange(100, 130)}q7{r.choice(['), ', '. ', ' '])}"
            parts.append(f"{r.choice(['so', 'then', 'now'])} {leads[k]} {seeds[k]() if k < 4 and r.random() < 0.7 else odd} {r.choice(['soon', 'today', ''])}")
        rows.append((i, " ".join(parts)))
    made = P.find_personal_data(docs_of(spark, rows), "doc_id", "text", settings).collect()
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["spans"]] for x in made}
    want = brute.bootstrapped(rows, settings)
    assert got == want
    if settings.accept < 0.9:
        assert any(k.startswith(P.FOUND) for x in want.values() for _, k, _ in x)


def test_sql_discovers_the_same(spark):
    rows = [(i, f"w{i} please call my number +1 (626) 555-57{10 + i} soon") for i in range(14)]
    rows += [(20, "now please call my number (X-77q41), soon"), (21, "elsewhere X-77q41 and X-99q41"), (22, None), (23, "mail a@b.org 4111 1111 1111 1111")]
    want = brute.bootstrapped(rows, P.Settings())
    assert [k for k, _, _ in [(k, a, b) for a, k, b in want[20]]] == ["context_phone"] and len(want[21]) == 1
    made = P.find_personal_data(docs_of(spark, rows), "doc_id", "text").collect()
    assert {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["spans"]] for x in made} == want
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = connection.execute(queries.ORACLE_SQL["op9_pii_bootstrap"]).fetchdf()
    assert dict(zip(found["doc_id"], found["spans"], strict=True)) == {i: ",".join(f"{k}:{a}:{b}" for a, k, b in x) for i, x in want.items()}


def test_rules_stay_linear_on_long_runs():
    import time

    runs = ("eyJ", "eyJa.", "eyJ.", "AKIA", "a", "password ", "password=", "password   ", "-----BEGIN ", "BEGIN PRIVATE ", "A ", "-", "api_key:'")
    for rule in B.RULES:
        for run in runs:
            start = time.time()
            B.spans_of(rule, run * (1_000_000 // len(run)))
            assert time.time() - start < 5, (rule.name, run)
    long = "eyJ" + "a" * 40 + ".b.c"
    jwt = next(r for r in B.RULES if r.name == "jwt")
    text = f"{long} x{long}\n{long}"
    assert [a for a, _ in B.spans_of(jwt, text)] == [0, text.rindex("eyJ")]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "secret=abcdef123", "keep", "old", "b", "s")], "path long, text string, found_blob string, found_spans string, blob string, spans string")
    made = B.findings(rows, "text", B.scan_unseen(rows, "text"))
    assert made.columns == ["path", "found_blob", "blob", "spans", "found_spans"]
    row = made.first()
    assert (row["found_blob"], row["blob"], row["spans"], len(row["found_spans"])) == ("keep", "b", "s", 1)
    judged = U.judge_terms(rows.withColumnRenamed("text", "soft_hits").withColumnRenamed("found_blob", "url"), "url")
    assert judged.columns == ["path", "url", "found_spans", "blob", "spans", *U.FOUND] and judged.count() == 1
