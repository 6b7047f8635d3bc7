"""Quality classifier: naive Bayes features for a linear support vector machine (Wang and Manning, 2012).

A text is the set of its n-grams: words (1, 2) and word shapes (1, 2, 3), hashed into ``DIMENSIONS``. Each indicator is
scaled by the log ratio of its smoothed counts in the two classes; a hinge-loss model on the scaled indicators, divided
by the root of their number, is fitted by dual coordinate descent (Hsieh et al., 2008). A logistic curve fitted on
rows the descent did not see turns margins into scores from 0 to 1.

The model is fitted on the driver from a bounded sample: the ``FIT_ROWS`` labelled rows with the least hash of their id. Only
their feature numbers are collected, all of them. Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfeed.llm.common import Words, steps

FIT_ROWS = 6_000
DIMENSIONS = 1 << 18
PENALTY, EPOCHS, SEED = 1.0, 12, 7
CUT = 0.3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shapes(words: pa.Array) -> pa.Array:
    """Kinds of characters in a word: letters ``a`` and ``A``, digits ``0``, marks of sentences ``.``, other marks ``#``."""
    for pattern, kind in ((r"[0-9]+", "0"), (r"\p{Lu}+", "A"), (r"[^A0\x00-\x60\x7b-\x7f]+|[b-z]+|a+", "a"), (r"a+", "a"), (r"[!?.,;:'\x22()]+", "."), (r"[^Aa0.]+", "#")):
        words = pc.replace_substring_regex(words, pattern, kind)
    return words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * MULTIPLIER


def features(texts: pa.Array, dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text; none for a NULL, empty or blank one."""
    words = Words(texts)
    if not len(words.index):
        return [np.zeros(0, np.int32)] * len(words)
    hashed = lambda x: pd.util.hash_array(x.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    word = hashed(pc.utf8_lower(words.distinct))[words.index]
    shape = hashed(shapes(words.distinct))[words.index]
    # A word that repeats the one before it has a shape of its own.
    shape[1:][words.index[1:] == words.index[:-1]] = np.uint64(1)
    shift = np.uint64(64 - (dimensions.bit_length() - 1))
    streams = []
    for kind, (base, width) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        rolled = np.full(max(0, len(base) - width + 1), kind + 1, np.uint64)
        for k in range(width):
            rolled = rolled * MULTIPLIER + base[k : k + len(rolled)]
        streams.append(((_mixed(rolled) >> shift).astype(np.int32), width))
    spans = zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)
    return [np.unique(np.concatenate([s[a : max(a, b - width + 1)] for s, width in streams])) for a, b in spans]


@dataclass
class Model:
    """Margin of a text: sum of ``weights`` over its features / root of their number + ``bias``; score: logistic of it."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        sums = np.array([self.weights[s].sum() / np.sqrt(max(1, len(s))) for s in sets], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * (sums + self.bias) + self.shift, -60, 60)))


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights on the scaled indicators and a bias: min |w|^2 / 2 + penalty * sum of hinge losses."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scaled = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([float(x @ x) + 1 for x in scaled])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)).tolist():
            y, x, r = labels[i], scaled[i], rows[i]
            gradient = y * (float(w[r] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), penalty)
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[r] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, with targets drawn in as Platt does."""
    good, bad = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g, h = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()]), p * (1 - p) + 1e-9
        hessian = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hessian, g)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
    return max(a, 0.0), b


def log_count_ratio(sets: list[np.ndarray], labels: np.ndarray, dimensions: int) -> np.ndarray:
    """For each feature the log of its smoothed share among the texts of class 1 over that among the others."""
    counts = np.ones((2, dimensions))
    for s, y in zip(sets, labels, strict=True):
        counts[int(y > 0)][s] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit(sets: list[np.ndarray], labels: np.ndarray, dimensions: int = DIMENSIONS, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """``labels``: 1 or -1. With one class only, every score is that class's share, drawn towards a half."""
    good = int((labels > 0).sum())
    if not good or good == len(labels):
        return Model(np.zeros(dimensions, np.float32), 0.0, 1.0, float(np.log((good + 1) / (len(labels) - good + 1))))
    # Every fifth row sees neither the ratios nor the descent: the logistic curve is fitted on those.
    check = np.arange(len(sets)) % 5 == 0
    if min((labels[check] > 0).sum(), (labels[check] < 0).sum(), (labels[~check] > 0).sum(), (labels[~check] < 0).sum()) == 0:
        check = np.zeros(len(sets), bool)
    fitted = np.flatnonzero(~check)
    ratio = log_count_ratio([sets[i] for i in fitted], labels[fitted], dimensions)
    w, bias = dual_descent([sets[i] for i in fitted], labels[fitted], ratio, penalty, epochs, seed)
    seen = np.flatnonzero(check) if check.any() else fitted
    weights = (w * ratio).astype(np.float32)
    model = Model(weights, bias, 1.0, 0.0)
    margins = np.array([weights[sets[i]].sum() / np.sqrt(max(1, len(sets[i]))) + bias for i in seen], np.float64)
    model.slope, model.shift = logistic(margins, labels[seen])
    return model


def held_out():
    """Rows no label is learned from: crc32 of the id as text leaves no remainder by 5. A NULL id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fitted on at most ``rows`` rows of ``docs`` that have a label and are not held out.

    Several labels of one document count as the larger; NULL labels and NULL ids are left out.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(column).cast("int").alias("_label"))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = known.join(present, F.col("_id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = features(batch.column("text"))
            data = pa.array([s.astype(np.int32).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), data], ["id", "label", "features"])

    found = texts.select("_id", "_label", "text").mapInArrow(run, "id long, label int, features binary").toPandas()
    # Repeated rows of one id are interchangeable only if equal, so the features decide their order.
    found = found.drop_duplicates("id") if found["id"].is_unique else found.sort_values(["id", "features"]).drop_duplicates("id")
    found = found.iloc[np.argsort(_mixed(found["id"].to_numpy(np.int64).view(np.uint64)), kind="stable")]
    sets = [np.frombuffer(b, np.int32) for b in found["features"]]
    return fit(sets, np.where(found["label"].to_numpy() > 0, 1, -1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (double, from 0 to 1); columns of that name are replaced. A NULL text scores as an empty one."""
    given = docs.drop("score")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(features(batch.column("text"))))], [*batch.schema.names, "score"])

    return given.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; an empty table gives no rows.

    Without any label every score is a half.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, column, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
