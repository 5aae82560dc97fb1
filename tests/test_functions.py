from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from curatrix.functions import queries as Q
from curatrix.functions import text as X
from curatrix.functions import urls as U
from curatrix.functions import vectors as V
from curatrix.operators import cache, filters


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_url_parts(spark):
    urls = [
        "https://WWW.Docs.Python.org/x", "http://me@www.a.www.b.com:80/?q", "no scheme", None,
        "https://[::1]:8080/x", "ftp://h",
    ]
    assert column(spark, urls, U.url_domain) == ["docs.python.org", "me@a.b.com:80", "", "", "[::1]:8080", "h"]
    assert column(spark, urls, U.url_hostname) == ["www.docs.python.org", "www.a.www.b.com", "", "", "::1", "h"]
    assert column(spark, ["http://h", "http://h/a?b#c", "http://h?x"], U.url_path) == ["/", "/a?b", "/?x"]


def test_rank_and_boost(spark):
    urls = [
        "https://docs.python.org/3", "https://readthedocs.io", "https://github.com/a/docs",
        "https://medium.com/x", "https://raw.githubusercontent.com/a", "https://a.pytorch.org",
        "https://notpytorch.org",
    ]
    assert column(spark, urls, U.url_rank) == pytest.approx([2.2, 2.2, 3.2, -2.0, 1.0, 0.0, 0.0])
    assert column(spark, urls, U.domain_boost) == [4.0, 0.0, 0.0, 0.0, 0.0, 3.5, 0.0]


def test_allowed_domain(spark):
    def allowed(url, *names):
        listed = F.array(*[F.lit(n) for n in names]).cast("array<string>")
        return column(spark, [url], lambda v: U.allowed_domain(v, listed))[0]

    assert allowed("https://x.org")
    assert allowed("https://api.Example.com/x", "www.example.com")
    assert not allowed("https://notexample.com", "example.com")
    assert allowed("https://b.org", "a.org", "B.org")


@pytest.mark.parametrize("strict", [False, True])
def test_private_hosts(spark, strict):
    private = [
        "localhost", "LOCALHOST.localdomain", "10.1.2.3", "172.16.0.1", "172.31.255.255", "192.168.1.1",
        "127.0.0.1", "169.254.169.254", "0.0.0.0", "::1", "0:0:0:0:0:0:0:1", "fc00::1", "fd12:3::", "fe80::1", "febf::",
    ]
    public = ["8.8.8.8", "172.32.0.1", "172.15.0.1", "11.0.0.1", "example.com", "10.0.0.256", "2001:db8::1", "fec0::1", "::", "fc.example.org"]
    assert column(spark, private, lambda v: U.is_private_host(v, strict)) == [True] * len(private)
    assert column(spark, public, lambda v: U.is_private_host(v, strict)) == [False] * len(public)
    assert column(spark, ["::ffff:10.0.0.1"], lambda v: U.is_private_host(v, strict)) == [strict]


def test_url_and_domain_errors(spark):
    urls = [
        "https://example.com/a", "", None, "ftp://x.org", "http:///p", "http://" + "a" * 2050,
        "https://x.org/?q=JavaScript:1", "http://10.0.0.1/", "https://[fe80::1]/", "javascript:alert(1)",
    ]
    assert column(spark, urls, U.url_error) == [
        None, "empty", "empty", "scheme", "no hostname", "too long",
        "suspicious pattern", "internal host", "internal host", "scheme",
    ]
    domains = ["Example.COM", "-a.com", "a..b", "", "a" * 63 + ".com", "a" * 64 + ".com", "a." * 130 + "com", "x y"]
    assert column(spark, domains, U.domain_error) == [None, "format", "format", "empty", None, "format", "too long", "format"]
    assert column(spark, domains[:2], U.normal_domain) == ["example.com", None]


def test_task_errors(spark):
    tasks = [
        "  build it ", "", " \n", "x" * 1001, "<SCRIPT src=a>b</script>", "use onclick = f", "call eval(x)",
        "run exec(", "__import__('os')", "open('f')", "open(f)", "data:text/html,x", "vbscript:x", "<script>\n</script>",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(tasks)], "i int, task string")
    got = filters.validate_task(df).orderBy("i").collect()
    assert got[0].valid_task == "build it"
    bad = [r.task_error for r in got]
    assert bad[1:4] == ["empty", "empty", "too long"]
    assert [b and b.split()[-1] for b in bad[4:]] == ["1", "5", "6", "7", "8", "9", None, "3", "4", None]


def test_request_bounds(spark):
    good = (1, "a task", 3, 1, 100, ["a.org"])
    rows = [good, (2, "a task", 2, 101, 2001, ["-"]), (3, "ab", 50, 100, 2000, []), (4, "a task", 101, None, 10001, None)]
    df = spark.createDataFrame(
        rows, "task_id int, task string, max_sources int, max_code_snippets int, chunk_size int, allowed_domains array<string>"
    )
    got = {r.task_id: r.errors for r in filters.validate_requests(df).collect()}
    assert got[1] == []
    assert got[2] == ["max_sources not in 3..50", "max_code_snippets not in 1..100", "chunk_size not in 100..2000", "invalid domain"]
    assert got[3] == ["task too short"]
    assert len(got[4]) == 5


def test_redaction(spark):
    key = "gh" + "p_" + "a" * 36
    texts = [
        f"use {key}!", "apify" + "_api_X1 end", "sk-or" + "-v1-abc", "Bearer a.b-c d", 'token = "abc"', "token:x", "tokens are fine",
    ]
    assert column(spark, texts, X.redact_secrets) == [
        "use ghp_[REDACTED]!", "apify_api_[REDACTED] end", "sk-or-v1-[REDACTED]", "Bearer [REDACTED] d",
        'token=[REDACTED]"', "token=[REDACTED]", "tokens are fine",
    ]
    rows = [("Bearer x", {"PASSWORD": "12345", "secret": "1234", "n": None}, ("abcdef", ["Bearer y", None], 3))]
    df = spark.createDataFrame(
        rows, "msg string, fields map<string,string>, nested struct<token:string,items:array<string>,n:int>"
    )
    out = filters.redact_fields(df).first()
    assert out.msg == "Bearer [REDACTED]"
    assert out.fields == {"PASSWORD": "1234...[REDACTED]", "secret": "1234", "n": None}
    assert out.nested.token == "abcd...[REDACTED]" and out.nested.n == 3
    assert out.nested["items"] == ["Bearer [REDACTED]", None]


def test_text_basics(spark):
    texts = ["  L'Élan\t“A” \xa0b_c! ", "", None, "a - b"]
    assert column(spark, texts, X.normalize_text) == ["lélan a b_c", "", "", "a  b"]
    assert column(spark, ["a\n b\xa0 c "], X.clean_text) == ["a b c"]
    broken = ["a\r\nb\rc\x0bd\x85e f\n", "\n", "", "a\n\n"]
    assert column(spark, broken, X.lines) == [s.splitlines() for s in broken]
    assert column(spark, ["\x1f\xa0 x 　\n"], X.strip) == ["x"]
    assert column(spark, ["a, b_c!", "", None], X.token_count) == [4, 0, 0]


def test_hashes(spark):
    a, b, c = column(spark, ["Same text!", "same   TEXT", "other"], X.content_hash)
    assert a == b != c and len(a) == 16
    sizes = [len(x) for x in column(spark, ["a b c d", "a b c d e", "a b c d e f", "a b c d e a b c d e a", ""], X.shingles)]
    assert sizes == [1, 1, 2, 5, 1]
    keys = column(spark, ["x" * 500, "x" * 501], X.embedding_cache_key)
    assert keys[0] != keys[1] and keys[0].startswith("emb_") and len(keys[0]) == 20


def test_terms_and_relevance(spark):
    assert column(spark, ["Build THE api for an API_2, ok"], X.task_terms) == [["api", "api_2"]]

    def score(task, text):
        return column(spark, [text], lambda v: X.text_relevance(F.lit(task), v))[0]

    assert score("read json files", "JSONfiles") == pytest.approx(2 / 3)
    assert score("read json", "how to read json") == 1.0
    assert score("to the", "anything") == 0.0
    assert score("api api web", "an API") == pytest.approx(2 / 3)
    assert score("api", None) == 0.0


def test_signals_and_queries(spark):
    task = " Use (FastAPI), pandas: and redis-py with REST. "
    s = column(spark, [task], Q.extract_signals)[0]
    assert s.libraries == s.frameworks == ["fastapi", "pandas"]
    assert s.concepts == ["and", "redis-py", "rest", "use", "with"]
    assert s.keywords == ["and", "fastapi", "pandas", "redis-py", "rest", "use", "with"] and s.language == ["python"]
    made = column(spark, [task, "fastapi", " "], lambda v: Q.expand_queries(v, Q.extract_signals(v)))
    core = "fastapi pandas and redis-py rest use"
    assert made[0] == [
        task.strip(), core, f"{task} tutorial", f"{core} tutorial",
        f"{task} official documentation", f"{core} official documentation",
    ]
    assert made[1][:3] == ["fastapi", "fastapi tutorial", "fastapi official documentation"]
    assert made[2][0] == "  tutorial"
    assert column(spark, [task, "x"], lambda v: Q.answer_tags(Q.extract_signals(v))) == [["fastapi", "pandas"], ["python"]]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    out = df.select(V.semantic_or_lexical(F.col("a"), F.col("b"), F.lit(0.5)).alias("s")).collect()
    assert [r.s for r in out] == [1.0, -1.0, 0.0, 0.5]


def test_cache_age_edges(spark):
    rows = [("fresh", "2024-01-01 11:30:00"), ("edge", "2024-01-01 11:00:00"), ("old", "2024-01-01 10:59:59"), ("none", None)]
    store = spark.createDataFrame(rows, "key string, at string").selectExpr("key", "cast(at as timestamp) cached_at", "key payload")
    asked = spark.createDataFrame([(k,) for k in ("fresh", "edge", "old", "none", "absent")], "key string")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    hits, misses = cache.cache_split(asked, store, now, 3600)
    assert sorted(r.key for r in hits.collect()) == ["edge", "fresh"]
    assert sorted(r.key for r in misses.collect()) == ["absent", "none", "old"]
    assert cache.cache_split(asked, store, now, None)[0].count() == 4


def test_percent_decoded(spark):
    texts = ["/a%2Fb", "/%C3%A9t%c3%a9", "/a+b%2B", "/100%", "/%zz%4", "%", "", None, "/%F0%9F%99%82", "/x%FFy", "/é%25"]
    want = [None if t is None else unquote(t, errors="replace") for t in texts]
    assert column(spark, texts, U.percent_decoded) == want


def test_robots_compares_decoded_paths(spark):
    body = "User-agent: *\nDisallow: /caf%C3%A9/\nDisallow: /a%20b\nDisallow: /ü\nDisallow: /50%"
    robots = spark.createDataFrame([("http://h", body)], "origin string, body string")
    urls = ["http://h/café/x", "http://h/caf%c3%a9/x", "http://h/c%61f%C3%A9/", "http://h/caf%E9/x", "http://h/a b", "http://h/a+b",
            "http://h/%C3%BCx", "http://h/50%/x", "http://h/50%25/x", "http://h/%", "http://h/cafe/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    kept = {r.url for r in filters.robots_allowed(pages, robots).collect()}
    peer = RobotFileParser()
    peer.parse(body.split("\n"))
    assert kept == {u for u in urls if peer.can_fetch("curatrix", u)}


def test_robots(spark):
    body = "\n".join([
        "User-agent: otherbot", "Disallow: /", "", "User-agent: Curatrix", "User-agent: third", "Allow: /a/b  # fine",
        "Disallow: /a", "", "User-agent: *", "Disallow: /z", "", "Disallow: /lost",
    ])
    robots = spark.createDataFrame(
        [("http://h", body), ("http://e", "User-agent: *\nDisallow:\n"), ("http://n", "User-agent: *\n\nDisallow: /")],
        "origin string, body string",
    )
    urls = ["http://h/a/b", "http://h/a", "http://h/z", "http://e/x", "http://n/x", "http://free/x", "http://h"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")

    def allowed(agent):
        return [u for u in urls if u in {r.url for r in filters.robots_allowed(pages, robots, agent).collect()}]

    assert allowed("curatrix/2.0") == [u for u in urls if u != "http://h/a"]
    assert allowed("unknown") == [u for u in urls if u != "http://h/z"]
    assert "http://h" not in allowed("otherbot")
