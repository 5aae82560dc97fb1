"""Text normalisation, hashing, shingles, tokens and term coverage. [T1, T2, T4 - T13]"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix import constants as K

TokenCounter = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once. An outer expression named inside a lambda is worked out again for
    every array element; a lambda variable is not."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def at_most(text: Column, chars: int | None) -> Column:
    """The first ``chars`` characters, or all of them where no number is asked for."""
    return text if chars is None else F.substring(text, 1, chars)


def first_items(array: Column, n: int | None) -> Column:
    return array if n is None else F.slice(array, 1, n)


def strip(text: Column) -> Column:
    """Trim any Unicode white space (Spark's trim knows spaces only)."""
    return F.regexp_replace(text, rf"^{K.WS}+|{K.WS}+\z", "")


def clean_text(text: Column) -> Column:
    """[T4] White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, K.WS + "+", " "))


def words(text: Column) -> Column:
    """Split on any white space, no empty words."""
    return F.filter(F.split(clean_text(text), " "), lambda w: w != "")


def lines(text: Column) -> Column:
    """Split on every line boundary; a final boundary opens no new line. Empty text has no lines."""
    body = F.regexp_replace(text, K.LINE_BREAK + r"\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, K.LINE_BREAK))


def normalize_text(text: Column) -> Column:
    """[T5] Lower case, single spaces, punctuation dropped, trimmed."""
    spaced = F.regexp_replace(F.lower(text_or_empty(text)), K.WS + "+", " ")
    return F.trim(F.regexp_replace(spaced, K.NOT_WORD_NOR_WS, ""))


def content_hash(text: Column) -> Column:
    """[T6] First 16 hex digits of SHA-256 over the normalised text."""
    return _hash_of(normalize_text(text))


def _hash_of(norm: Column) -> Column:
    return F.substring(F.sha2(norm, 256), 1, 16)


def shingles(text: Column, size: int = K.SHINGLE_WORDS) -> Column:
    """Distinct word shingles of the normalised text; a short text is one shingle of its own."""

    def of_words(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(parts) - (size - 1))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, size), " "))
        return F.when(F.size(parts) >= size, F.array_distinct(windows))

    norm = normalize_text(text)
    return F.coalesce(let(_norm_words(norm), of_words), F.array(norm))


def shingle_hashes(text: Column, size: int = K.SHINGLE_WORDS) -> Column:
    """[T7] The same shingles as sorted 64-bit hashes: every word is hashed once, and a shingle
    is the hash of its word hashes."""
    return _shingle_hashes_of(normalize_text(text), size)


def _shingle_hashes_of(norm: Column, size: int) -> Column:
    def of_words(words_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words_) - size)
        windows = F.transform(starts, lambda i: F.xxhash64(*[words_[i + k] for k in range(size)]))
        return F.when(F.size(words_) >= size, F.array_distinct(windows))

    hashed = F.transform(_norm_words(norm), lambda w: F.xxhash64(w))
    return F.sort_array(F.coalesce(let(hashed, of_words), F.array(F.xxhash64(norm))))


def _norm_words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """[T8] Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda shared: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))
        ),
    )


def fingerprint(text: Column, size: int = K.SHINGLE_WORDS) -> Column:
    """[T9] Content hash and shingle hashes in one struct; the text is normalised once."""
    return let(
        normalize_text(text),
        lambda norm: F.struct(
            _hash_of(norm).alias("content_hash"), _shingle_hashes_of(norm, size).alias("shingle_hashes")
        ),
    )


def is_duplicate(a: Column, b: Column, threshold: float = K.NEAR_DUP_JACCARD) -> Column:
    """[T10] Two fingerprints: equal hash, or Jaccard at or over the threshold."""
    return (a["content_hash"] == b["content_hash"]) | (
        jaccard(a["shingle_hashes"], b["shingle_hashes"]) >= threshold
    )


def cache_key(prefix: str, value: Column) -> Column:
    """[T11] ``prefix_`` and the first 16 hex digits of SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 16))


def embedding_cache_key(text: Column) -> Column:
    """[T11] The whole text takes part: texts that only begin alike have keys of their own."""
    return cache_key("emb", text)


def task_cache_key(task: Column, config: Column) -> Column:
    return cache_key("task", F.concat(task, F.lit("_"), config))


def config_hash(*parameters: Column) -> Column:
    """[T12] SHA-256 of the pipe-joined parameters; arrays are joined by commas."""
    return F.sha2(F.concat_ws("|", *parameters), 256)


def token_count(text: Column) -> Column:
    """[T13] Words and single punctuation marks. Any ``Column -> Column`` can take its place."""
    return F.regexp_count(text_or_empty(text), F.lit(K.TOKEN))


def task_terms(task: Column) -> Column:
    """[T1] Lower-case terms of more than two characters without stop words; repeats are kept."""
    found = F.regexp_extract_all(F.lower(task), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(K.STOP_WORDS))


def text_relevance(task: Column, text: Column) -> Column:
    """[T2] Share of the task's terms that occur inside the text, for a known pair.

    A text that holds the whole task holds every term, so the phrase bonus, which is cut at 1,
    can never change the value.
    """
    def share(terms: Column) -> Column:
        def of_text(lowered: Column) -> Column:
            hits = F.size(F.filter(terms, lambda t: F.contains(lowered, t)))
            return F.when(F.size(terms) > 0, hits / F.greatest(F.size(terms), F.lit(1)))

        return F.coalesce(let(F.lower(text_or_empty(text)), of_text), F.lit(0.0))

    return let(task_terms(task), share)


def redact_secrets(text: Column) -> Column:
    """Token-like values are replaced, in a fixed order."""
    for pattern, mask in K.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern.replace(r"\s", K.WS), mask)
    return text


def is_seo_spam(text: Column) -> Column:
    """The text holds one of the spam phrases."""
    return let(F.lower(text_or_empty(text)), lambda low: contains_any(low, K.SPAM_PHRASES))


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found
