from curatrix.sources.tables import PAGES
from curatrix.streaming import rows


def test_pages_to_chunks_on_a_stream(spark, tmp_path):
    def page(word):
        return f"<html><head><title>{word}</title></head><body><p>{(word + ' text ') * 60}</p></body></html>"

    data = [
        ("http://h/1", 200, "text/html", page("one")), ("http://h/2", 200, "text/html", page("one")),
        ("http://h/3", 404, "text/html", page("two")), ("http://h/4", 200, "text/html", page("coupon")),
        ("http://h/5", 200, "text/html", page("three")),
    ]
    df = spark.createDataFrame(data, "url string, status_code int, content_type string, text string")
    df.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS fetched_at").select(
        "url", "status_code", "content_type", "text", "fetched_at"
    ).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert "fetched_at" in PAGES
    docs = rows.first_copies(rows.document_stream(rows.page_stream(spark, str(tmp_path / "in"))))
    query = (
        rows.chunk_stream(docs, 100).writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    sources = {r.source for r in out}
    assert sources in ({"http://h/1", "http://h/5"}, {"http://h/2", "http://h/5"})
    assert all(r.tokens <= 100 or "\n" not in r.text for r in out)
