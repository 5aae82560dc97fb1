"""Collocations beside plain counting."""

import random
import re
from collections import Counter

import pytest

from curatrix.llm import collocations as C


def plain(docs, s):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, s.longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= s.least}
    gone = set()
    for (lang, p), a in found.items():
        gone |= {(lang, p[i : i + k]) for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * counts[lang, p[i : i + k]]}
    by: dict[str, list] = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            by.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, n))
    return {(lang, i + 1, p.decode(), -a, left, right, n, -score) for lang, rows in by.items() for i, (score, a, p, left, right, n) in enumerate(sorted(rows)[: s.top])}


def made(spark, docs, s, parts=3):
    table = spark.createDataFrame([(t, g, "x", 1) for t, g in docs], "text string, lang string, phrase string, a int").repartition(parts)
    return {tuple(r) for r in C.mine(table, "text", "lang", s).collect()}


@pytest.mark.parametrize("block", [300, 1_000_000])
def test_equals_plain_counting(spark, block):
    r = random.Random(2)
    vocabulary = ["the", "The", "of", "éa", "漢字", "x\x00y", "\xa0", "new", "york", "city", "hall", "-", "a-b", "\x1c"]
    docs = []
    for i in range(150):
        words = r.choices(vocabulary, k=r.randrange(0, 60))
        if i % 3 == 0:
            words += ["new", "york", "city"]
        if i % 9 == 0:
            words += ["one", "fixed", "phrase", "of", "many", "words"] * 2
        docs.append(("".join(w + r.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "\x0b", " "]) for w in words), r.choice(["en", "fr", None, "und", ""])))
    docs += [(None, "en"), ("", None), (" \t", "fr"), (".,;", "fr"), ("word " * 300, "en"), ("very long piece " * 200, "de")]
    s = C.Settings(least=7, top=40, block=block, bits=16, parts=4)
    assert made(spark, docs, s) == plain(docs, s)


def test_small_bitmaps_lose_nothing(spark):
    r = random.Random(3)
    docs = [(" ".join(f"w{int(r.expovariate(0.002))}" for _ in range(2000)), "en") for _ in range(40)]
    for bits in (15, 24):
        s = C.Settings(least=4, top=100_000, bits=bits, block=20_000)
        assert made(spark, docs, s) == plain(docs, s)


def test_empty(spark):
    assert made(spark, [], C.Settings()) == set()
    assert made(spark, [(None, None)], C.Settings()) == set()


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = [("new york city hall and more words", "en")] * 30
    table = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    s = C.Settings(least=7, bits=16)
    assert {tuple(r) for r in C.mine(table.mapInArrow(counted, table.schema), "text", "lang", s).collect()} == plain(docs, s)
    assert read.value == len(docs)


def test_rows_of_stripes_are_bounded_by_buckets(spark):
    r = random.Random(4)
    docs = [(" ".join(f"w{r.randrange(30)}" for _ in range(3000)), lang) for lang in ("en", "fr") for _ in range(4)]
    table = spark.createDataFrame(docs, "text string, lang string").repartition(2)
    s = C.Settings(least=2, top=100_000, bits=16, buckets=5, block=1_000_000)
    stored = C.store_blocks(table, s)
    rows = C.fill_stripes(stored, 3, C.bitmap(C.count_pairs(stored, s), s.bits), C.np.zeros(0, "int64"), s)
    counters = rows.selectExpr("explode(counts) c").count()
    assert rows.count() <= stored.count() * s.buckets < 100 < counters
    assert made(spark, docs, s) == plain(docs, s)


def test_products_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**12, 9 * 10**12, 10**6, 10**12)], "a long, n long, l long, r long")
    ratio = "(CAST(1000 * a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(19, 0)))"
    assert C.RATIO == ratio
    assert rows.selectExpr(f"{C.RATIO} AS x").first()[0] == 1000 * 10**12 * 9 * 10**12 // (10**6 * 10**12)
