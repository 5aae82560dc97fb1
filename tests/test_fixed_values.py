"""Values and texts that results depend on, stated once more as literals."""

from pyspark.sql import functions as F

from curatrix import constants as K
from curatrix.functions import extract as E


def test_numbers():
    assert (K.TASK_MIN_CHARS, K.TASK_MAX_CHARS, K.URL_MAX_CHARS, K.DOMAIN_MAX_CHARS, K.PAGE_MIN_CHARS) == (3, 1000, 2048, 253, 200)
    assert (K.MAX_SOURCES, K.MAX_CODE_SNIPPETS, K.CHUNK_SIZE) == ((3, 50), (1, 100), (100, 2000))
    assert (K.WEB_MIN_RELEVANCE, K.CODE_MIN_RELEVANCE, K.ANSWER_MIN_RELEVANCE) == (0.18, 0.16, 0.22)
    assert (K.CHUNK_PRUNE, K.SNIPPET_PRUNE, K.CRITICAL, K.HELPFUL) == ((0.18, 0.55), (0.20, 0.60), 0.40, 0.25)
    assert (K.TOP_CHUNKS, K.URLS_PER_DOMAIN, K.SHINGLE_WORDS, K.NEAR_DUP_JACCARD) == (16, 3, 5, 0.85)
    assert (K.PAGE_TTL_SECONDS, K.TASK_TTL_SECONDS) == (86_400, 3_600)


def test_lists():
    assert K.STOP_WORDS == ["a", "an", "and", "or", "the", "to", "for", "of", "in", "on", "with", "that", "this", "create", "build", "make"]
    assert K.REMOVED_TAGS == ["nav", "footer", "script", "style", "noscript", "aside", "form"]
    assert K.PRACTICE_WORDS == ["should", "avoid", "recommended", "best practice", "must"]
    assert [points for _, points in K.URL_RANK_RULES] == [2.2, 1.0, -2.0]
    assert {k: [w for _, w in v] for k, v in K.PATTERN_RULES.items()} == {
        "authentication": [6, 7, 5], "caching": [8, 9, 7], "async_concurrency": [9, 6, 7], "database_access": [5, 7, 8],
        "api_client": [7, 4, 6], "error_handling": [6, 5, 8], "configuration": [6, 8, 7], "logging": [7, 8],
    }


def one(spark, html, make):
    return spark.createDataFrame([(html,)], "h string").select(make(E.main_html(F.col("h"))).alias("x")).first().x


def test_page_text_by_hand(spark):
    html = (
        "<html><body><nav>menu</nav><article><h1>A  title</h1><p>One <b>bold</b> and <i>soft</i> word.</p>"
        "<ul><li>first</li><li>second &amp; last</li></ul><p>See <a href='http://x/y'>this</a>.<br>New line</p>"
        "<script>no()</script></article><footer>foot</footer></body></html>"
    )
    assert one(spark, html, E.html_to_text) == (
        "# A  title\n\nOne **bold** and *soft* word.\n\n* first\n* second & last\n\nSee [this](http://x/y).\nNew line"
    )


def test_code_of_tokens_in_spans(spark):
    """Pieces of a block are joined by line feeds, and count as lines."""
    html = "<article><pre><code class='python'><span>import os</span><span>print(os.getcwd())</span><span>exit_with_status(0)</span></code></pre></article>"
    found = one(spark, html, E.html_snippets)
    assert {s.language for s in found} <= {"python", "text"} and len(found) == 2
    assert all(s.code.split() == ["import", "os", "print(os.getcwd())", "exit_with_status(0)"] and "\n" in s.code for s in found)
