"""Quality rules with line sequence labelling.

Lines of a text become binary features; a linear-chain conditional random field with two states,
content and boilerplate, scores them together with their neighbours, and Viterbi decoding marks
every line. A document is kept if enough of its words stand on content lines. Beside it stand
plain counts: repeated lines, symbols, repeated 8-word windows.

The field is fitted by maximum conditional likelihood on a bounded sample of labelled documents,
at most ``Settings.per_class`` of each class: the lines of documents with label 1 count as content
and those of documents with label 0 as boilerplate. Features compare a line with its own document
only, so decoding is one narrow pass.

Defined results: a null or empty text has no words and fails the base rules; lines without a word
take no part in labelling; repeated rows get equal results; without labels of both classes stated
default weights are used; an empty table gives no rows; only the named columns are read. Very long
texts are decoded as a whole, in time and memory that grow with their lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import byte_words, text_bytes

CONTENT, BOILERPLATE = 0, 1
FEATURES = (
    "one", "few words", "many words", "symbols", "many symbols", "bare symbols", "shouting", "loud marks", "one case of words",
    "doubled words", "ends like a sentence", "starts high", "digits", "long words", "short words", "repeated line", "rights or terms",
)
#: Weights (content minus boilerplate) where nothing can be fitted, and the bonus of staying.
DEFAULTS = (0.5, 0.0, 0.5, -1.0, -2.5, -2.0, -2.5, -1.5, 0.0, -3.0, 0.8, 0.2, -0.3, -0.5, 0.0, -1.0, -1.5)
STAY = 1.0

_SYMBOL = re.compile(rb"[#*$%&|<>]")
_TERMS = re.compile(rb"(?i)\b(all rights reserved|copyright|cookie|privacy policy|terms of (use|service)|sign (in|up)|log ?in|subscribe|licen[sc]ed under)\b")


@dataclass(frozen=True)
class Settings:
    per_class: int = 1500  # labelled documents of each class that the fit may read
    steps: int = 80
    ridge: float = 0.002
    least_share: float = 0.5  # of words on content lines
    least_words: int = 20
    repeat_percent: int = 30


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[int]:
    """Numbers of the features that a line with at least one word has."""
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(line))
    letters = sum(w.isupper() for w in words)
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    last = words[-1].rstrip(b"\"')")[-1:]
    has = (
        True,
        n <= 3,
        n >= 8,
        symbols * 20 > n,
        symbols * 4 > n,
        sum(len(w) == 1 and w in b"#*$%&|<>" for w in words) * 5 > n,
        letters * 2 > n,
        line.count(b"!") * 5 > n,
        n >= 4 and letters == 0 and not any(w[:1].isupper() for w in words),
        doubled * 5 > n,
        last in (b".", b"?", b"!", b":"),
        words[0][:1].isupper() or words[0][0] >= 0xC3,
        sum(w.isdigit() for w in words) * 5 > n,
        chars > 9 * n,
        chars < 3 * n,
        repeated,
        _TERMS.search(line) is not None,
    )
    return [i for i, x in enumerate(has) if x]


def document_lines(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature matrix and number of words of the lines with a word, and how many lines equal an
    earlier line."""
    seen: set[bytes] = set()
    every = [(line, byte_words(line)) for line in data.split(b"\n")]
    every = [(line, words) for line, words in every if words]
    x = np.zeros((len(every), len(FEATURES)), np.float32)
    repeats = 0
    for i, (line, words) in enumerate(every):
        again = line in seen
        seen.add(line)
        repeats += again
        x[i, line_features(line, words, again)] = 1
    return x, np.array([len(w) for _, w in every], np.int64), repeats


def _by_step(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(step, number of sequences that reach it) for sequences of falling length."""
    counts = Counter(lengths.tolist())
    alive = len(lengths)
    for t in range(int(lengths.max(initial=0))):
        alive -= counts.get(t, 0)
        yield t, alive


def _ordered(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return order, starts[order]


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """States of the best path of each sequence; ``emissions`` holds the lines of all sequences,
    ``moves`` the score from one state to the next. Ties go to content."""
    states = np.zeros(len(emissions), np.int8)
    if not len(emissions):
        return states
    order, starts = _ordered(lengths)
    back = np.zeros((len(emissions), 2), np.int8)
    best = np.zeros((len(lengths), 2))
    for t, alive in _by_step(lengths[order]):
        at = starts[:alive] + t
        if t == 0:
            best[:alive] = emissions[at]
            continue
        ways = best[:alive, :, None] + moves[None]
        back[at] = ways.argmax(axis=1)
        best[:alive] = ways.max(axis=1) + emissions[at]
    now = best.argmax(axis=1).astype(np.int8)
    for t, alive in reversed(list(_by_step(lengths[order]))):
        at = starts[:alive] + t
        states[at] = now[:alive]
        if t:
            now[:alive] = back[at, now[:alive]]
    return states


def fit(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by 2) and moves (2 by 2) of the greatest conditional likelihood."""
    n, k = x.shape
    order, starts = _ordered(lengths)
    steps = list(_by_step(lengths[order]))
    w, m = np.zeros((k, 2)), np.zeros((2, 2))
    onehot = np.eye(2)[y]
    pair_seen = np.zeros((2, 2))
    first = np.zeros(n, bool)
    first[starts[lengths[order] > 0]] = True
    np.add.at(pair_seen, (y[:-1][~first[1:]], y[1:][~first[1:]]), 1)
    moment = [np.zeros_like(w), np.zeros_like(m)]
    square = [np.zeros_like(w), np.zeros_like(m)]
    for step in range(1, s.steps + 1):
        e = x @ w
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        for t, alive in steps:
            at = starts[:alive] + t
            a[at] = e[at] if t == 0 else e[at] + np.logaddexp.reduce(a[at - 1][:, :, None] + m[None], axis=1)
        for t, alive in reversed(steps):
            if t:
                at = starts[:alive] + t
                b[at - 1] = np.logaddexp.reduce(m[None] + (e[at] + b[at])[:, None, :], axis=2)
        both = a + b
        p = np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])
        inner = np.flatnonzero(~first)
        pairs = a[inner - 1][:, :, None] + m[None] + (e[inner] + b[inner])[:, None, :]
        flat = pairs.reshape(len(inner), 4)
        expected = np.exp(flat - np.logaddexp.reduce(flat, axis=1)[:, None]).sum(axis=0).reshape(2, 2)
        gradients = [x.T @ (onehot - p) / n - s.ridge * w, (pair_seen - expected) / n - s.ridge * m]
        for i, (value, g) in enumerate(zip((w, m), gradients, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            value += 0.15 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    return w, m


@dataclass(frozen=True)
class Model:
    weights: tuple[tuple[float, float], ...] = tuple((v, 0.0) for v in DEFAULTS)
    moves: tuple[tuple[float, float], ...] = ((STAY, 0.0), (0.0, STAY))


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model from the bounded sample, fitted in one task."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND key IS NOT NULL")
    order = [F.xxhash64("key"), "key"]
    some = [named.filter(F.col("label") == c).orderBy(*order).limit(settings.per_class) for c in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows of 12 bytes
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(sample, "key")
    bounded = chosen.orderBy(*order, "label", F.xxhash64("text")).limit(2 * settings.per_class)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, lengths, ys = [], [], []
        for part in parts:
            for text_, label_ in zip(part["text"], part["label"], strict=True):
                x, _, _ = document_lines(text_.encode())
                xs.append(x)
                lengths.append(len(x))
                ys.append(np.full(len(x), CONTENT if label_ == 1 else BOILERPLATE))
        if xs and len(set(np.concatenate(ys).tolist())) == 2:
            w, m = fit(np.concatenate(xs).astype(np.float64), np.array(lengths), np.concatenate(ys), settings)
            yield pd.DataFrame({"w": [w.ravel().tolist()], "m": [m.ravel().tolist()]})

    made = bounded.repartition(1).mapInPandas(run, "w array<double>, m array<double>").collect()
    if not made:
        return Model()
    w, m = np.array(made[0]["w"]).reshape(-1, 2), np.array(made[0]["m"]).reshape(2, 2)
    return Model(tuple(map(tuple, w.tolist())), tuple(map(tuple, m.tolist())))


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of ``size`` (a power of two) that occur twice or more in the text. Exact:
    equal windows get equal numbers by doubling, from words to pairs, fours and eights."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(words):
        return 0
    step = 1
    while step < size:
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    again = np.bincount(ids)[ids] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    mark[at] += 1
    mark[at + size] -= 1
    return int((np.cumsum(mark) > 0).sum())


NEW = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)


def judge(docs: DataFrame, key: str, text: str, model: Model, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """key and, per row: the counts, base_failed, the share of words on content lines (0 without
    words) and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = np.array(model.weights), np.array(model.moves)
        for batch in batches:
            texts = list(text_bytes(batch, "text"))
            if not texts:
                continue
            lines = [document_lines(t) for t in texts]
            lengths = np.array([len(x) for x, _, _ in lines], np.int64)
            x = np.concatenate([x for x, _, _ in lines])
            content = viterbi(x @ w, lengths, m) == CONTENT
            n_words, good, chars, symbols, repeats = [], [], [], [], []
            at = 0
            for data, (_, sizes, _) in zip(texts, lines, strict=True):
                words = byte_words(data)
                n_words.append(len(words))
                good.append(int(sizes[content[at : at + len(sizes)]].sum()))
                at += len(sizes)
                joined = b"".join(words)
                chars.append(len(joined.decode()))
                symbols.append(len(_SYMBOL.findall(joined)))
                repeats.append(repeated_words(words))
            n, r = np.array(n_words), np.array(repeats)
            failed = (n < settings.least_words) | (100 * r > settings.repeat_percent * n)
            share = np.array(good) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()),
                    pa.array([d for _, _, d in lines], pa.int64()), pa.array(r, pa.int64()), pa.array(failed),
                    pa.array(share), pa.array(~failed & (share >= settings.least_share)),
                ],
                ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {NEW}").withColumnRenamed("key", key)
