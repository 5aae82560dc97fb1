"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A lower-cased text becomes counts of hashed character 1-, 2- and 3-grams, weighted by
``(1 + log tf) * idf`` and brought to length one. A softmax model is trained by
follow-the-regularised-leader (one adaptive step a coordinate, elastic net: the L1 part makes weights exactly zero, the L2 part
shrinks the others); then one temperature, fitted on rows held back from the training, calibrates its probabilities.

Document frequencies cover all learnable rows: one count per slot and task, added up by Spark. The fit reads at
most ``Settings.rows`` rows, the same number of each language, in the order of a hash, and only the
``Settings.langs`` most frequent languages; it runs in one task on those rows' sparse vectors. Prediction is one narrow pass over all rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text where
no row can be learned from; a label that is null is not learned; equal scores go to the first language by name; repeated
rows get equal results; very long texts are counted piece by piece; an empty table gives no rows; other
columns pass through, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from curatrix.llm.common import row_key

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
LETTERS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # the model has 2 ** bits slots
    longest: int = 3  # characters of an n-gram
    rows: int = 4000  # rows that the fit may read
    langs: int = 256  # languages that are told apart
    hold_back: int = 4  # every so many-th of them fits the temperature only
    epochs: int = 2
    alpha: float = 0.5  # step size
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.2


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for m in LETTER.finditer(text) for c in m.group())


def term_counts(text: str, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's character n-grams, ascending, and how often each occurs."""
    lower = text.lower()
    total = np.zeros(1 << bits, np.int64)
    shift = np.uint64(64 - bits)
    for at in range(0, len(lower), LETTERS_AT_ONCE):
        # A piece takes the first characters of the next one along, for n-grams that begin in it.
        size = min(LETTERS_AT_ONCE, len(lower) - at)
        points = np.frombuffer(lower[at : at + size + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        gram = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for n in range(longest):
                inside = min(size, len(points) - n)
                if inside <= 0:
                    break
                gram = (gram[:inside] << np.uint64(21)) | points[n : n + inside]
                slot = (gram + np.uint64(n + 1)) * _MIX[0]
                total += np.bincount(((slot ^ (slot >> np.uint64(31))) * _MIX[1] >> shift).astype(np.int64), minlength=len(total))
    slots = np.flatnonzero(total)
    return slots, total[slots]


def weighted(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of length one."""
    v = (1 + np.log(counts)) * idf[slots]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Leader:
    """Follow-the-regularised-leader for softmax regression: sums of gradients (z) and of their
    squares (n); weights are derived from them where they are needed."""

    def __init__(self, slots: int, classes: int, s: Settings) -> None:
        self.z, self.n, self.s = np.zeros((slots, classes)), np.zeros((slots, classes)), s

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, s = self.z[slots], self.s
        shrunk = np.sign(z) * s.l1 - z
        return np.where(np.abs(z) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(self.n[slots])) / s.alpha + s.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        error = softmax(values @ w)
        error[label] -= 1
        g = values[:, None] * error
        old = self.n[slots]
        new = old + g * g
        self.z[slots] += g - (np.sqrt(new) - np.sqrt(old)) / self.s.alpha * w
        self.n[slots] = new


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits under which the labels are likeliest, by search over its logarithm."""

    # Labels count as certain but for one row of each other class, so that the divisor stays finite where all are right.
    doubt = 1 / (len(labels) + logits.shape[1])
    target = np.full(logits.shape, doubt)
    target[np.arange(len(labels)), labels] = 1 - doubt * (logits.shape[1] - 1)

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - (target * x).sum(axis=1)).mean())

    low, high = -4.0, 4.0
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights by slot and class, and the temperature, from (slots, values) rows."""
    held = np.zeros(len(rows), bool)
    for c in range(classes):
        held[np.flatnonzero(labels == c)[s.hold_back - 1 :: s.hold_back]] = True
    model = Leader(1 << s.bits, classes, s)
    use, order = np.flatnonzero(~held), np.random.default_rng(11)
    for _ in range(s.epochs):
        for i in order.permutation(use):
            model.learn(*rows[i], labels[i])
    w = model.weights(np.arange(1 << s.bits))
    check = np.flatnonzero(held) if held.any() else use
    logits = np.array([v @ w[slots] for slots, v in (rows[i] for i in check)])
    return w, temperature(logits, labels[check])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: bytes  # float32
    weights: bytes  # float32, by slot and language, divided by the temperature
    settings: Settings


def document_frequencies(docs: DataFrame, text: str, s: Settings) -> tuple[int, np.ndarray]:
    """Number of texts, and in how many of them each slot occurs; ``2 ** bits`` numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << s.bits, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                found[term_counts(x.as_py(), s.bits, s.longest)[0]] += 1
                n += 1
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(found[used], n))], ["slot", "n"])

    rows = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(run, "slot long, n long")
    out, total = np.zeros(1 << s.bits, np.int64), 0
    for r in rows.groupBy("slot").agg(F.sum("n").alias("n")).collect():
        if r["slot"] < 0:
            total = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return total, out


def train(docs: DataFrame, text: str, lang: str, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model from the rows of ``docs`` that have a text and a language."""
    s = settings
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(s.langs).collect()
    langs = tuple(sorted(r["lang"] for r in known))
    if not langs:
        return Model((), b"", b"", s)
    n, found = document_frequencies(rows, "text", s)
    idf = np.log((1 + n) / (1 + found)) + 1
    each = max(1, s.rows // len(langs))
    # Chosen by hash first, without the texts; repeated rows are one.
    keyed = rows.select("text", "lang", row_key(F.col("text")).alias("row"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    listed = F.create_map(*(F.lit(x) for i, g in enumerate(langs) for x in (g, i)))[F.col("lang")]
    chosen = keyed.select("lang", "row").distinct().withColumn("place", place).filter(F.col("place") <= each).withColumn("label", listed).filter("label IS NOT NULL")
    # At most ``rows`` rows (one a language at least) of some thirty bytes.
    some = keyed.join(F.broadcast(chosen), ["lang", "row"]).groupBy("label", "row").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [term_counts(x, s.bits, s.longest) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("row"), pa.array([x.tolist() for x, _ in made], pa.list_(pa.int32())), pa.array([c.tolist() for _, c in made], pa.list_(pa.int32()))],
                ["label", "row", "slots", "counts"],
            )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(parts)
        if not every or not sum(map(len, every)):
            return
        frame = pd.concat(every).sort_values(["label", "row"])
        pairs = [(x, weighted(x, c, idf)) for x, c in zip(frame["slots"].map(np.asarray), frame["counts"].map(np.asarray), strict=True)]
        w, t = fit(pairs, frame["label"].to_numpy(), len(langs), s)
        yield pd.DataFrame({"weights": [(w / t).astype(np.float32).tobytes()]})

    sparse = some.select("label", "row", "text").mapInArrow(vectors, "label int, row long, slots array<int>, counts array<int>")
    made = sparse.repartition(1).mapInPandas(run, "weights binary").collect()
    return Model(langs, idf.astype(np.float32).tobytes(), bytes(made[0]["weights"]), s)


def predict(docs: DataFrame, text: str, model: Model, into: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language and its calibrated probability."""
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (into, score)))
    names = kept.columns
    s = model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.frombuffer(model.idf, np.float32).astype(float)
        weights = np.frombuffer(model.weights, np.float32).reshape(-1, max(len(model.langs), 1))
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(names.index(text)):
                value = x.as_py()
                if not model.langs or not has_letter(value):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                slots, counts = term_counts(value, s.bits, s.longest)
                p = softmax(weighted(slots, counts, idf) @ weights[slots].astype(float))
                best = int(np.argmax(p))
                langs.append(model.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, into, score])

    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType()), T.StructField(score, T.DoubleType())])
    return kept.mapInArrow(run, schema)
