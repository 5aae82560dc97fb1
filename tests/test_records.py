from functools import partial

import pytest
from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.operators import assemble
from curatrix.operators.prompts import PromptCaps, build_prompts
from curatrix.plans.curate import curate
from curatrix.sources import payloads, tables

CHUNKS = "task_id bigint, rank int, source string, text string, tokens int, score double, bucket string"
SNIPPETS = "task_id bigint, rank int, source string, language string, description string, code string, score double, bucket string"
DOCS = (
    "task_id bigint, seq bigint, source string, title string, summary string, "
    "api_references array<struct<library:string,function:string,description:string>>, "
    "best_practices array<struct<practice:string,reason:string>>"
)
PATTERNS = (
    "task_id bigint, pattern_type string, description string, code_snippet string, source string, "
    "confidence double, first_seen bigint"
)
ANSWERS = (
    "task_id bigint, seq bigint, question_title string, question_url string, answer_body string, "
    "score bigint, accepted boolean, tags array<string>"
)


def record(spark, chunks=(), snippets=(), docs=(), patterns=(), answers=(), most=10, make=assemble.assemble_context):
    tasks = spark.createDataFrame([(1, "my task", most)], "task_id bigint, task string, max_code_snippets int")
    tables_ = [spark.createDataFrame(list(r), s) for r, s in zip((chunks, snippets, docs, patterns, answers), (CHUNKS, SNIPPETS, DOCS, PATTERNS, ANSWERS))]
    return make(tasks, *tables_)


def chunk(rank, score, source="s", text="text"):
    return (1, rank, source, text, 3, score, "critical" if score >= 0.4 else "helpful")


def snippet(rank, score, source="s", code="code"):
    return (1, rank, source, "python", "d", code, score, "critical" if score >= 0.4 else "helpful")


def doc(seq, source, functions=(), practices=(), summary="sum"):
    return (1, seq, source, f"t{seq}", summary, [("l", f, "x") for f in functions], [(p, "r") for p in practices])


def test_empty_task_has_a_record(spark):
    r = record(spark).first()
    assert r.task == "my task" and r.relevant_context == [] and all(len(x) == 0 for x in r.context)
    assert r.open_questions == [K.NO_CODE, K.NO_ANSWERS, K.FEW_CHUNKS]
    assert r.recommended_next_context == [K.NEXT_EXAMPLES, K.NEXT_API]


@pytest.mark.parametrize("criticals,helpful", [(2, True), (3, False)])
def test_helpful_rows_need_fewer_than_three_critical(spark, criticals, helpful):
    rows = [chunk(i + 1, 0.9 - i / 100, text="c" * 500) for i in range(criticals)] + [chunk(9, 0.3, text="h" * 500)]
    code = [snippet(1, 0.5), snippet(2, 0.3)]
    r = record(spark, rows, code).first()
    assert [x.bucket for x in r.relevant_context] == ["critical"] * criticals + ["helpful"] * helpful
    assert {len(x.key_detail) for x in r.relevant_context if x.bucket == "critical"} == {500}
    assert len(r.context.code_snippets) == 1 + helpful
    if helpful:
        assert len(r.relevant_context[-1].key_detail) == 500
    assert r.open_questions == [K.NO_ANSWERS]


def test_caps_rounding_and_order(spark):
    rows = [chunk(i + 1, 0.5625) for i in range(40)]
    code = [snippet(i + 1, 0.9 - i / 100) for i in range(6)]
    r = record(spark, rows, code, most=4).first()
    assert len(r.relevant_context) == 40 and r.relevant_context[0].relevance_score == 0.562
    assert [x.relevance_score for x in r.context.code_snippets] == [0.9, 0.89, 0.88, 0.87]


def test_doc_lists(spark):
    docs = [doc(i, f"s{i}", [f"f{i}.{j}" for j in range(8)] + ["same"], [f"p{i}.{j}" for j in range(6)] + [""]) for i in range(30)]
    docs[2] = doc(2, "s2", summary="")
    rows = [chunk(i + 1, 0.9, f"s{i}") for i in range(28)]
    c = record(spark, rows, docs=docs).first().context
    assert [x.title for x in c.concepts] == [f"t{i}" for i in range(28) if i != 2]
    names = [x.function for x in c.api_references]
    assert names[:10] == [f"f0.{j}" for j in range(8)] + ["same", "f1.0"] and len(names) == 27 * 8 + 1
    assert names.count("same") == 1
    assert len(c.best_practices) == 27 * 6 and all(x.practice for x in c.best_practices)


def test_asked_for_caps(spark):
    caps = assemble.Caps(chunks=3, concepts=2, references=4, practices=1, critical_chars=5, answer_chars=6)
    docs = [doc(i, f"s{i}", [f"f{i}"], [f"p{i}"]) for i in range(9)]
    rows = [chunk(i + 1, 0.9, f"s{i}", text="c" * 50) for i in range(9)]
    answers = [(1, 1, "Q", "u", "b" * 50, 5, True, [])]
    r = record(spark, rows, docs=docs, answers=answers, make=partial(assemble.assemble_context, caps=caps)).first()
    assert [x.key_detail for x in r.relevant_context] == ["c" * 5] * 3
    sizes = [len(r.context[x]) for x in ("concepts", "api_references", "best_practices")]
    assert sizes == [2, 4, 1] and r.context.stackoverflow_answers[0].answer_body == "b" * 6


def test_patterns_and_answers(spark):
    patterns = [(1, "caching", "d", "x" * 1500, "s", 0.65, 5), (1, "logging", "d", "y", "s", 0.75, 9), (1, "api_client", "d", "y", "s", 0.65, 2)]
    answers = [(1, 2, "Q2", "u", "b" * 3000, 4, True, ["python"]), (1, 1, "Q1", "u", "b", 5, True, [])]
    c = record(spark, patterns=patterns, answers=answers).first().context
    assert [x.pattern_type for x in c.implementation_patterns] == ["logging", "api_client", "caching"]
    assert len(c.implementation_patterns[2].code_snippet) == 1500
    assert [(x.question_title, len(x.answer_body)) for x in c.stackoverflow_answers] == [("Q1", 1), ("Q2", 3000)]


def test_flat_layout(spark):
    rows = [chunk(1, 0.9), chunk(2, 0.3)]
    c = record(spark, rows, [snippet(i + 1, 0.9) for i in range(4)], [doc(0, "other")], most=3, make=assemble.assemble_flat).first().context
    assert [(x.text, x.tokens) for x in c.llm_chunks] == [("text", 3)] * 2
    assert len(c.code_snippets) == 3 and [x.source for x in c.concepts] == ["other"]


def test_kept_docs(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "task_id bigint, source string")
    kept = assemble.kept_sources(spark.createDataFrame([(1, "b"), (1, "b")], "task_id bigint, source string"))
    got = assemble.docs_of_sources(docs, kept).collect()
    assert sorted((r.task_id, r.source) for r in got) == [(1, "b"), (2, "a")]


def test_prompt(spark):
    full = record(
        spark, [chunk(1, 0.9, "https://s", "detail")], [snippet(1, 0.5, "https://s", "run()")],
        [doc(0, "https://s", ["f.g"], ["you should"])], [(1, "caching", "Caching", "code", "s", 0.65, 1)],
        [(1, 1, "Q", "https://q", "body", 7, True, [])],
    )
    prompt = build_prompts(full).first().prompt
    assert prompt == (
        "## Developer Task\n\nmy task\n\n"
        "## Pre-Ranked Context (already filtered for relevance)\n\n"
        f"[CRITICAL] https://s: {K.WHY_CRITICAL}\n> detail\n\n"
        "## Documentation Context\n\n### t0\nsum\nSource: https://s\n\n"
        "## Code Examples\n\n### d [CRITICAL]\n```python\nrun()\n```\nSource: https://s\n\n"
        "## API References\n\n- `f.g`: x\n\n"
        "## Best Practices\n\n- you should\n\n"
        "## Implementation Patterns\n\n### caching (confidence: 0.65)\nCaching\n```\ncode\n```\n\n"
        "## StackOverflow Answers\n\n### Q (score: 7)\nbody\nSource: https://q\n\n"
        f"## Known Gaps (from pipeline)\n\n- {K.FEW_CHUNKS}\n" + K.PROMPT_CLOSING
    )


def test_long_prompt_is_cut(spark):
    docs = [doc(i, f"s{i}", summary="x" * 5000) for i in range(12)]
    full = record(spark, [chunk(i + 1, 0.9, f"s{i}") for i in range(12)], docs=docs)
    assert K.PROMPT_CUT not in build_prompts(full).first().prompt
    prompt = build_prompts(full, PromptCaps(concepts=10, prompt_chars=32_000)).first().prompt
    assert prompt.endswith(K.PROMPT_CUT + K.PROMPT_CLOSING)
    assert len(prompt) == 32_000 + len(K.PROMPT_CUT) + len(K.PROMPT_CLOSING)


def test_search_hits(spark):
    rows = [
        (1, "q", 0, "t", "", "", "b"), (1, "q", 1, "t", "", "https://a.docs.python.org/x", "b"), (1, "q", 2, None, "https://b.org", "https://c", None),
        (1, "q", 3, "t", "https://late", "", "b"), (1, "r", 4, "t", "https://b.org", "", "b"),
    ]
    got = payloads.search_hits(spark.createDataFrame(rows, tables.SEARCH_HITS), 3).orderBy("seq").collect()
    assert [(r.seq, r.url, r.score) for r in got] == [(1, "https://a.docs.python.org/x", 4.0), (2, "https://b.org", 0.0), (4, "https://b.org", 0.0)]
    assert got[1].title == "" and got[1].snippet == ""


def test_api_payloads_from_json(spark, tmp_path):
    (tmp_path / "repos.json").write_text(
        '{"task_id":1,"seq":2,"items":[{"full_name":"a/b","html_url":"https://github.com/a/b","stargazers_count":1000000,"default_branch":null},'
        '{"full_name":"c/d","description":"x"}]}\n'
    )
    read = tables.read_table(spark, str(tmp_path / "repos.json"), tables.REPO_PAYLOAD, "json")
    got = payloads.github_repo_candidates(read).orderBy("seq").collect()
    assert [(r.url, r.score) for r in got] == [("https://github.com/a/b#readme", 5.0), ("https://raw.githubusercontent.com/a/b/main/README.md", 5.5)]
    (tmp_path / "code.json").write_text(
        '{"task_id":1,"seq":0,"items":[{"path":"x/examples/A.PY","repository":{"full_name":"a/b","html_url":"https://github.com/a/b"}},'
        '{"path":"","html_url":"u","repository":{"full_name":"a/b"}},{"path":"y.txt","html_url":"u"}]}\n'
    )
    read = tables.read_table(spark, str(tmp_path / "code.json"), tables.CODE_PAYLOAD, "json")
    got = payloads.github_code_candidates(read).orderBy("seq").collect()
    assert [r.url for r in got] == ["https://github.com/a/b/blob/HEAD/x/examples/A.PY", "https://raw.githubusercontent.com/a/b/HEAD/x/examples/A.PY"]
    assert [r.score for r in got] == pytest.approx([3.3, 3.7])


def test_answers_join(spark):
    q = spark.createDataFrame(
        [(1, 0, 7, "A &lt;b&gt;", ["x"], True, 70), (1, 1, 8, "t", [], False, 80), (1, 2, 9, "t", [], True, None), (1, 3, 10, "t", [], True, 100)],
        tables.QUESTIONS,
    )
    a = spark.createDataFrame([(70, "<p>one</p><p>1 &lt; 2</p>", 5), (80, "b", 1), (99, "b", 1)], tables.ANSWERS)
    got = payloads.stackoverflow_answers(q, a).collect()
    assert [(r.question_title, r.question_url, r.score, r.accepted) for r in got] == [("A <b>", "https://stackoverflow.com/questions/7", 5, True)]
    assert got[0].answer_body.split() == ["one", "1", "<", "2"]


def test_sinks(spark, tmp_path):
    tables.write_results(record(spark), str(tmp_path / "out"), F.lit("2024-01-02"))
    assert (tmp_path / "out" / "run_date=2024-01-02").is_dir()
    entries = spark.createDataFrame([("k", "v")], "key string, payload string").withColumn("cached_at", F.lit("2024-01-01").cast("timestamp"))
    tables.write_cache(entries, str(tmp_path / "cache"))
    tables.write_cache(entries, str(tmp_path / "cache"))
    assert tables.read_cache(spark, str(tmp_path / "cache")).count() == 2


def test_curation_end_to_end(spark):
    code = "import redis\nclient = redis.Redis()\n@cache\ndef get_cache(key):\n    return client.get(key)\n"

    def page(word):
        return (
            f"<html><head><title>{word} redis caching guide</title></head><body><article><h1>Redis caching</h1>"
            f"<p>You should always set an expiry for {word} redis caching keys in python.</p>"
            f"<pre><code class='python'>{code}# {word}</code></pre><p>{(word + ' caching with redis in python ') * 8}</p></article></body></html>"
        )

    tasks = spark.createDataFrame(
        [(1, "redis caching in python", 5, 4, 500, ["example.org"]), (2, "unrelated quantum chemistry", 5, 4, 500, [])],
        "task_id bigint, task string, max_sources int, max_code_snippets int, chunk_size int, allowed_domains array<string>",
    )
    urls = ["https://www.example.org/a", "https://docs.example.org/b", "https://example.org/copy", "https://example.org/spam", "https://other.net/x", "https://docs.example.org/robot"]
    hits = spark.createDataFrame([(1, "q", i, "redis caching", u, "", "python") for i, u in enumerate(urls)], tables.SEARCH_HITS)
    texts = [page("alpha"), page("beta"), page("alpha"), page("coupon"), page("other"), page("robot")]
    pages = spark.createDataFrame([(u, 200, "text/html", t) for u, t in zip(urls, texts)], "url string, status_code int, content_type string, text string")
    robots = spark.createDataFrame([("https://docs.example.org", "User-agent: *\nDisallow: /robot")], tables.ROBOTS)
    answers = spark.createDataFrame([(1, 0, "redis caching", "u", "use python", 3, True, ["redis"]), (1, 1, "other", "u", "thing", 3, True, [])], ANSWERS)
    run = curate(tasks, hits, pages, answers, robots=robots, per_query=10)
    one, two = run.records.orderBy("task_id").collect()
    sources = {x.source for x in one.relevant_context}
    assert "https://docs.example.org/b" in sources and not sources & {"https://other.net/x", "https://example.org/spam", "https://docs.example.org/robot"}
    assert len(sources & {"https://www.example.org/a", "https://example.org/copy"}) == 1
    assert 0 < len(one.context.code_snippets) <= 4
    assert "caching" in {p.pattern_type for p in one.context.implementation_patterns}
    assert one.context.best_practices and one.context.api_references
    assert [a.question_title for a in one.context.stackoverflow_answers] == ["redis caching"]
    assert one.open_questions == [K.FEW_CHUNKS]
    assert two.relevant_context == [] and len(two.open_questions) == 3
    figures = {r.task_id: r for r in run.report(tasks).collect()}
    assert figures[1].spam_filtered == 1 and figures[1].documents == 3 and figures[1].sources_found == 5
    assert figures[2].documents == 0 and figures[2].chunks == 0
