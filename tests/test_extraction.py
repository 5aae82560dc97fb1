from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import extract as E
from curatrix.operators import filters, patterns
from curatrix.operators.extraction import doc_children, extract_documents

CODE = "import os\ndef handler(event):\n    return os.environ.get('A')\n"
PAGE = f"""<html><head><title> My &amp; Page </title><script>var t="</p>";</script></head><body>
<nav><a href="/x">menu</a></nav><article class="main"><h1>Top <em>title</em></h1>
<p>You should always validate uploaded files before storing them.</p><h2></h2>
<p>See <a href="https://x.org/d">docs</a> and call client.fetch(url, 3)<br>now &#8364; &#x41;.</p>
<ul><li>one</li><li><b>two</b></li></ul>
<pre><code class="language-python">{CODE}</code></pre><pre>short</pre>
<aside>side</aside><!-- note --></article><footer>foot</footer></body></html>"""


def docs(spark, pages):
    rows = [(u, 200, c, t) for u, c, t in pages]
    df = spark.createDataFrame(rows, "url string, status_code int, content_type string, text string")
    return {r.source: r for r in extract_documents(df).collect()}


def test_html_page(spark):
    doc = docs(spark, [("http://h/p", "text/html", PAGE)])["http://h/p"]
    assert doc.title == "My & Page"
    assert doc.headings == ["Top title"]
    for part in ("# Top *title*", "[docs](https://x.org/d)", "now € A.", "* one", "* **two**", "```\nimport os"):
        assert part in doc.markdown
    for part in ("menu", "side", "foot", "note", "var t", "<"):
        assert part not in doc.markdown
    assert [s.language for s in doc.snippets] == ["python", "python", "text"]
    assert doc.snippets[0].description == "Extracted code block from My & Page"
    assert doc.snippets[2].description == "Markdown fenced snippet from My & Page"
    assert {s.code for s in doc.snippets} == {CODE.strip()}
    assert [(r.library, r.function) for r in doc.api_references][:1] == [("client", "client.fetch")]
    assert doc.api_references[0].description == "Usage pattern with arguments: (url, 3)"
    assert [p.practice for p in doc.best_practices] == ["You should always validate uploaded files before storing them."]
    assert doc.summary.startswith("# Top *title* You should")


def test_markdown_page(spark):
    body = "# One\n\n## Two  x\n\n##### Five\n\n```Python\n" + CODE + "```\n\n```\none line that is long enough to count, but one\n```\n" + "x" * 200
    found = docs(spark, [("http://h/a.md", "text/plain", body), ("http://h/dir/", "text/markdown", body)])
    doc = found["http://h/a.md"]
    assert doc.title == "a.md" and found["http://h/dir/"].title == "README"
    assert doc.headings == ["One", "Two x"]
    assert [(s.language, s.code) for s in doc.snippets] == [("python", CODE.strip())]
    assert doc.markdown == body


def test_limits(spark):
    heads = "".join(f"<h2>h{i}</h2>" for i in range(30))
    calls = " ".join(f"fn{i:02d}(x)" for i in range(30)) + " ab(x) abc(x)"
    tips = "\n\n".join(f"You must do thing number {i:02d} with great care" for i in range(20))
    pages = [
        ("http://h/1", "text/html", "x" * 199), ("http://h/2", "text/html", "x" * 200),
        ("http://h/3", "text/html", f"<body>{heads}<p>{calls}</p><p>{'y' * 200}</p></body>"),
        ("http://h/4.md", "text/html", tips + "\n" + "z" * 40000),
    ]
    found = docs(spark, pages)
    assert "http://h/1" not in found and found["http://h/2"].title == "http://h/2"
    assert len(found["http://h/3"].headings) == 30 and len(found["http://h/3"].api_references) == 31
    assert len(found["http://h/4.md"].best_practices) == 20
    assert len(found["http://h/4.md"].markdown) > 40000 and len(found["http://h/4.md"].summary) <= 400
    frame = spark.createDataFrame(pages, "url string, content_type string, text string")
    short = {r.source: r for r in extract_documents(frame, body_chars=100, max_headings=20).collect()}
    assert len(short["http://h/3"].headings) == 20 and len(short["http://h/4.md"].markdown) == 100


def test_practice_line_lengths(spark):
    def line(n):
        return ("You should " + "x" * n)[:n]

    text = "\n".join([line(39), line(40), "  " + line(220) + "  ", line(221), "x" * 50])
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(E.best_practices(F.col("t")).alias("p")).first().p
    assert [len(p.practice) for p in got] == [40, 220]


def test_calls_need_three_letters(spark):
    df = spark.createDataFrame([("ab(x) abc(y) a.b.c(1, 2) éab(z) _x1()",)], "t string")
    got = df.select(E.api_references(F.col("t")).alias("r")).first().r
    assert [(r.library, r.function) for r in got] == [("abc", "abc"), ("a", "a.b.c"), ("_x1", "_x1")]


def test_languages(spark):
    rows = [
        ("language-Python", "x", "python"), ("lang-js", "x", "javascript"), ("shell", "x", "bash"), ("", " $ ls", "bash"),
        ("yml", "x", "yaml"), ("", "import a\ndef f(): 1", "python"), ("", "const a = 1", "javascript"),
        ("", "a: 1\nb: 2\nc-d : 3", "yaml"), ("", "a: 1\nb: 2", "text"), ("", "a: 1\nb: 2\nc: {}", "text"), (None, "plain", "text"),
    ]
    df = spark.createDataFrame(rows, "c string, code string, want string")
    for r in df.select("*", E.guess_language(F.col("c"), F.col("code")).alias("got")).collect():
        assert r.got == r.want, r


def test_children_and_dedupe(spark):
    page = f"<html><body><pre><code>{CODE}</code></pre><p>{'w ' * 150}</p></body></html>"
    df = spark.createDataFrame([("http://h/p", "text/html", page)], "url string, content_type string, text string")
    found = extract_documents(df)
    assert [r.child_no for r in doc_children(found, "snippets").collect()] == [0, 1, 2]
    assert doc_children(found, "snippets", dedupe=True).count() == 1


def test_page_filters(spark):
    rows = [
        ("a", 399, "text/html", "x"), ("b", 400, "text/html", "x"), ("c", 200, "image/png", "x"), ("d", 200, "application/json", "x"),
        ("e", 200, "TEXT/HTML", "x"), ("f", 200, "text/x", "y" * 200_000), ("g", 200, "text/x", "y" * 200_001),
    ]
    df = spark.createDataFrame(rows, "url string, status_code int, content_type string, text string")
    assert sorted(r.url for r in filters.fetched_ok(df).collect()) == ["a", "d", "f", "g"]
    assert sorted(r.url for r in filters.fetched_ok(df, max_chars=200_000).collect()) == ["a", "d", "f"]
    spam = spark.createDataFrame([("Best PRICE", "x"), ("ok", "with Coupon"), ("ok", None), ("fine", "ok")], "title string, summary string")
    assert filters.not_spam(spam).count() == 2


def test_patterns(spark):
    rows = [
        (0, "jwt token"), (1, "requests get("), (2, "post( rest endpoint requests"), (3, "@lru_cache redis set_cache"),
        (4, "async   def f(): await gather()"), (5, "login with password"), (6, ""), (7, "import structlog; LOGGER = getLogger"),
    ]
    df = spark.createDataFrame([(1, i, f"s{i}", c) for i, c in rows], "task_id int, seq int, source string, code string")
    got = {}
    for r in patterns.detect_patterns(df).collect():
        got.setdefault(r.seq, {})[r.pattern_type] = round(r.confidence, 6)
    assert 0 not in got and 6 not in got
    assert got[1] == {"api_client": 0.55}
    assert got[2] == {"api_client": 0.85}
    assert got[3]["caching"] == 1.0
    assert got[4]["async_concurrency"] == 0.8
    assert got[5]["authentication"] == 0.6
    assert got[7]["logging"] == 0.75
    # put( and rest: 0.4 + 0.6 is no more than 1.0
    weak = spark.createDataFrame([(1, 0, "s", "put( rest")], df.schema)
    assert patterns.detect_patterns(weak).count() == 0
    best = {r.pattern_type: (r.source, r.confidence) for r in patterns.best_patterns(patterns.detect_patterns(df)).collect()}
    assert best["api_client"] == ("s2", 0.85)
    assert set(best) <= set(K.PATTERN_TEXT)


def test_snippets_of_odd_tags(spark):
    """Attributes and body of a block are found as one; entities of every kind are read back."""
    body = "x &lt; 1 &amp;&amp; y &#65;&#x42; z = 1\nsecond line of this block of code"
    pages = [
        f"<article><pre>{body}</pre></article>",
        f"<article><pre data-a='1' class='language-py'><code>{body}</code></pre></article>",
        f"<article><pre\n><b>{body}</b> > 2</pre></article>",
        "<article><prefix>none</prefix></article>",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: r.s for r in rows.select("id", E.html_snippets(F.col("html")).alias("s")).collect()}
    plain = "x < 1 && y AB z = 1\nsecond line of this block of code"
    assert [(s.language, s.code) for s in got[0]] == [("text", plain)]
    assert [(s.language, s.code) for s in got[1]] == [("python", plain), ("text", plain)]
    assert [s.code for s in got[2]] == [plain + "\n > 2"]
    assert got[3] == [] and got[4] is None


def test_a_text_is_unescaped_from_one_value(spark):
    rows = spark.createDataFrame([("a&lt;b",)], "t string")
    plan = rows.select(E.unescape_html(F.lower("t")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
