import pytest

from curatrix.llm import url_vocab as U


@pytest.mark.parametrize(
    ("url", "verdict"),
    [
        ("http://x.org/lottery/results", "allow"), ("http://x.org/replica-sets", "allow"), ("http://x.org/betting/betting", "allow"), ("http://escort.org", "allow"),
        ("http://x.org/lottery/win", "block"), ("http://x.org/replica?betting", "block"), ("http://x.org/free/win", "block"), ("http://x.org/casino", "block"),
    ],
)
def test_one_soft_term_never_rejects(spark, url, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    assert U.filter_urls(pages, "page_id", "url").first()["verdict"] == verdict
