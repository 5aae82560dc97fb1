"""Quality classifier: naive Bayes support vectors.

Texts become indicators of hashed n-grams: byte 1-, 2- and 3-grams, words, word pairs, a doubled
word, and 3- to 6-grams of the text's shape, in which runs of capitals, of other letters, of digits
and of each mark are one sign each. Each indicator is scaled by the logarithm of the ratio of its smoothed class counts,
then a linear model with hinge loss is fitted by dual coordinate descent, and its margin becomes a
probability by a logistic fit on rows held back from the descent.

The fit reads a bounded sample: at most ``Settings.per_class`` labelled rows of each class, in
the order of a hash of their id. It runs in one task on that sample; the model is one vector of
``2 ** Settings.bits`` weights. Scoring is one narrow pass over all rows.

Defined results: a null text scores like the empty text, which has no indicator and gets the score of no evidence;
rows without a label do not take part in the fit; repeated rows get equal scores; ties of the sample's hash go by
id, label and text; very long texts are read whole, in one pass of fixed memory beside the text; a column called like the score is replaced; where a class
has no labelled row every score is the share of label 1 among the labels (0.5 without labels);
empty tables give no rows; only the id and text columns of the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import byte_words, text_bytes


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # the model has 2 ** bits weights
    per_class: int = 3000  # labelled rows of each class that the fit may read
    smoothing: float = 1.0
    least_rows: int = 10  # a slot that fewer rows of the fit hold has no weight
    cost: float = 4.0  # bound of the dual variables
    epochs: int = 20
    hold_back: int = 4  # every so many-th sampled row fits the probabilities only


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
DOUBLED = 0x5851F42D4C957F2D
#: Sign of each byte in a shape: A, a, 9, or the byte itself; letters beyond ASCII are "a".
_SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def indicators(data: bytes, bits: int) -> np.ndarray:
    """Distinct slots of a text's n-grams, ascending."""
    shift = np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            if len(raw) >= n:
                gram = raw[: len(raw) - n + 1].astype(np.uint64)
                for k in range(1, n):
                    gram = (gram << np.uint64(8)) | raw[k : len(raw) - n + 1 + k]
                gram = (gram + np.uint64(n << 32)) * np.uint64(_MIX[0])
                seen[(gram ^ (gram >> np.uint64(29))) * np.uint64(_MIX[1]) >> shift] = True
        signs = _SHAPE[raw]
        shape = signs[np.append(True, signs[1:] != signs[:-1])] if len(signs) else signs
        for n in (3, 4, 5, 6):
            if len(shape) >= n:
                gram = shape[: len(shape) - n + 1].astype(np.uint64)
                for k in range(1, n):
                    gram = (gram << np.uint64(8)) | shape[k : len(shape) - n + 1 + k]
                gram = (gram + np.uint64((n + 10) << 56)) * np.uint64(_MIX[2])
                seen[(gram ^ (gram >> np.uint64(29))) * np.uint64(_MIX[0]) >> shift] = True
        words = byte_words(data)
        if words:
            digest = xxhash.xxh64_intdigest
            h = np.fromiter(map(digest, words), np.uint64, len(words))
            seen[h * np.uint64(_MIX[1]) >> shift] = True
            pair = h[:-1] * np.uint64(_MIX[0]) + h[1:]
            pair[h[:-1] == h[1:]] = np.uint64(DOUBLED)
            seen[(pair ^ (pair >> np.uint64(31))) * np.uint64(_MIX[2]) >> shift] = True
    return np.flatnonzero(seen)


def scaled_row(row: np.ndarray, values: np.ndarray, floor: float) -> np.ndarray:
    """A row's scaled indicators, brought to length one; shorter ones are divided by ``floor``, so
    a text of a few words says little."""
    v = values[row]
    return v / max(float(np.sqrt(v @ v)), floor)


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, epochs: int, floor: float) -> np.ndarray:
    """Weights of the linear hinge-loss model over indicators scaled by ``values``: dual
    coordinate descent, one dual variable per row, kept within 0 and ``cost``."""
    w = np.zeros(len(values))
    alpha = np.zeros(len(rows))
    scaled = [scaled_row(r, values, floor) for r in rows]
    square = np.array([float(v @ v) for v in scaled])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            gradient = y[i] * float(scaled[i] @ w[rows[i]]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w[rows[i]] += step * y[i] * scaled[i]
                alpha[i] = new
                moved = max(moved, abs(step) * square[i])
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of labels to margins, with targets drawn in
    from 0 and 1 by one row of each class."""
    up, down = float(label.sum()), float((1 - label).sum())
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = weight * (p - target)
        h = np.maximum(weight * p * (1 - p), 1e-9)
        ga, gb = float(g @ margin) + 1e-3 * a, float(g.sum())
        haa, hab, hbb = float(h @ margin**2) + 1e-3, float(h @ margin), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-8:
            break
    return max(a, 1e-6), b


def log_odds(row: np.ndarray, ratio: np.ndarray, weights: np.ndarray, offset: float, floor: float) -> float:
    return float(scaled_row(row, ratio, floor) @ weights[row]) + offset


def fit(texts: list[bytes], labels: np.ndarray, share: float, s: Settings) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Log-count ratios and weights by slot, an offset, and the least length. ``share`` is the share of label 1
    among all labelled rows."""
    rows = [indicators(t, s.bits) for t in texts]
    labels = np.asarray(labels, np.int64)
    size = 1 << s.bits
    held = np.zeros(len(rows), bool)
    if min(int(labels.sum()), int((1 - labels).sum())) >= 2 * s.hold_back:
        for c in (0, 1):
            held[np.flatnonzero(labels == c)[:: s.hold_back]] = True
    use = np.flatnonzero(~held)
    counts = [np.full(size, s.smoothing), np.full(size, s.smoothing)]
    for i in use:
        counts[labels[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts[0] + counts[1] - 2 * s.smoothing < s.least_rows] = 0.0
    floor = max(float(np.median([np.sqrt(ratio[rows[i]] @ ratio[rows[i]]) for i in use])), 1e-12)
    w = descend([rows[i] for i in use], ratio, 2 * labels[use] - 1, s.cost, s.epochs, floor)
    check = np.flatnonzero(held) if held.any() else use
    margin = np.array([log_odds(rows[i], ratio, w, 0.0, floor) for i in check])
    found = labels[check]
    each = np.where(found > 0, share / max(found.mean(), 1e-9), (1 - share) / max(1 - found.mean(), 1e-9))
    a, b = logistic(margin, found, each)
    return ratio, a * w, b, floor


@dataclass(frozen=True)
class Model:
    bits: int
    ratio: bytes  # float32
    weights: bytes  # float32
    offset: float
    floor: float = 1.0


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model from the labelled rows; ``labels`` has ``key`` and ``label`` (0 or 1)."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND key IS NOT NULL")
    totals = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(totals.values())
    zeros = np.zeros(1 << settings.bits, np.float32).tobytes()
    share = totals.get(1, 0) / n if n else 0.5
    if len(totals) < 2:
        odds = np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))
        return Model(settings.bits, zeros, zeros, float(odds))
    order = [F.xxhash64("key"), "key"]
    some = [named.filter(F.col("label") == c).orderBy(*order).limit(settings.per_class) for c in (0, 1)]
    sample = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows of 12 bytes
    chosen = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(sample, "key")
    bounded = chosen.orderBy(*order, "label", F.xxhash64("text")).limit(2 * settings.per_class)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = list(parts)
        if not every:
            return
        rows = pd.concat(every)
        if not len(rows) or rows["label"].nunique() < 2:
            return
        ratio, weights, offset, floor = fit([t.encode() for t in rows["text"]], rows["label"].to_numpy(), share, settings)
        yield pd.DataFrame({"ratio": [ratio.astype(np.float32).tobytes()], "weights": [weights.astype(np.float32).tobytes()], "offset": [offset], "floor": [floor]})

    made = bounded.repartition(1).mapInPandas(run, "ratio binary, weights binary, offset double, floor double").collect()
    if not made:
        return Model(settings.bits, zeros, zeros, float(np.log(share / (1 - share))))
    return Model(settings.bits, bytes(made[0]["ratio"]), bytes(made[0]["weights"]), made[0]["offset"], made[0]["floor"])


def score(docs: DataFrame, text: str, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with ``into``: the probability of label 1."""
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != into))
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weights = (np.frombuffer(x, np.float32).astype(np.float64) for x in (model.ratio, model.weights))
        for batch in batches:
            margin = np.array([log_odds(indicators(t, model.bits), ratio, weights, model.offset, model.floor) for t in text_bytes(batch, text)])
            made = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.astype(np.float64))], [*names, into])

    return rows.mapInArrow(run, schema)
