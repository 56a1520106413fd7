"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Binary n-gram indicators are scaled by their smoothed class log-count ratio, and a linear classifier
with squared hinge loss is fitted on them by dual coordinate descent (Hsieh et al., 2008).
The n-grams are those of one to four bytes, and pairs of neighbouring words by their sameness, which
tell repeated words and passages from prose in any language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribospark.llm.text import byte_values, labelled_sample
from tribospark.session import materialise

#: Labelled documents to learn from, at most about; one task fits on their n-grams.
TRAIN_ROWS = 8000
#: n-grams are hashed into so many slots, and those of each length into a quarter of them.
SLOTS = 1 << 18
#: The last slots hold the word repetition indicators instead.
REPEAT_SLOTS = 64
#: Bytes whose n-grams are hashed at once, which bounds a task's memory.
PIECE = 1 << 20
SMOOTHING = 1.0
COST = 1.0
#: Passes over the sample at most, and the largest violation at which they end.
PASSES, TOLERANCE = 60, 0.01
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float


def repetition(words: list[bytes]) -> list[int]:
    """Indicators of how much a text repeats: share of words equal to the last, of distinct words, of distinct word pairs."""
    n = len(words)
    if n < 2:
        return []
    same = sum(map(eq, words, islice(words, 1, None))) / (n - 1)
    pairs = len(set(zip(words, islice(words, 1, None)))) / (n - 1)
    long = min(n.bit_length() // 2, 7)
    return [int(same * 7.99), 8 + int(pairs * 15.99), 24 + long, 32 + min(int(len(set(words)) / n * 31.99), 31)]


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct slots of a text; an empty text has none."""
    on = np.zeros(SLOTS, bool)
    quarter = np.uint32(SLOTS // 4 - 1)
    for start in range(0, len(text), PIECE):
        data = np.frombuffer(text[start : start + PIECE + 3], np.uint8).astype(np.uint32)
        rolled = np.zeros(len(data), np.uint32)
        for n, multiplier in enumerate(_MULTIPLIERS):
            if len(data) <= n:
                break
            rolled = (rolled[: len(data) - n] * np.uint32(31) + data[n:] + np.uint32(1)) * multiplier
            on[((rolled >> np.uint32(14)) & quarter) + np.uint32(n * (SLOTS // 4))] = True
    on[SLOTS - REPEAT_SLOTS :] = False
    for slot in repetition(text.lower().split()):
        on[SLOTS - REPEAT_SLOTS + slot] = True
    return np.flatnonzero(on)


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed indicator counts of both classes."""
    counts = np.full((2, SLOTS), SMOOTHING)
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    seen = counts.sum(axis=0) > 2 * SMOOTHING
    logs = np.log(counts / counts[:, seen].sum(axis=1, keepdims=True))
    return np.where(seen, logs[1] - logs[0], 0.0)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with squared hinge loss, solved in its dual.

    Each step sets one row's multiplier to its best value. The rows come in a new random order in each
    pass; it ends when no multiplier's gradient is off by more than TOLERANCE.
    """
    weights, bias = np.zeros(SLOTS), 0.0
    multiplier = np.zeros(len(rows))
    diagonal = 1 / (2 * costs)
    curvature = np.array([v @ v + 1.0 for v in values]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        worst = 0.0
        for i in order.permutation(len(rows)):
            row, value, sign = rows[i], values[i], signs[i]
            gradient = sign * (weights[row] @ value + bias) - 1 + diagonal[i] * multiplier[i]
            new = max(multiplier[i] - gradient / curvature[i], 0.0)
            worst = max(worst, abs(gradient) if multiplier[i] > 0 else -gradient)
            step = (new - multiplier[i]) * sign
            if step:
                multiplier[i] = new
                weights[row] += step * value
                bias += step
        if worst <= TOLERANCE:
            break
    return weights, bias


def scaled(rows: list[np.ndarray], ratio: np.ndarray) -> list[np.ndarray]:
    """Each row's log-count ratios, scaled to length one so that long texts weigh as short ones."""
    out = []
    for row in rows:
        value = ratio[row]
        length = np.sqrt(value @ value)
        out.append(value / length if length else value)
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a penalised logistic curve; the targets are drawn in as Platt (1999) does."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    design, beta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fits a bounded sample. With one class only, every text gets that class; with no rows 0.5."""
    ones = int(labels.sum())
    if ones in (0, len(labels)):
        return Model(np.zeros(SLOTS, np.float32), 0.0, 0.0, 0.0 if not len(labels) else 4.0 if ones else -4.0)
    ratio = log_count_ratio(rows, labels)
    values = scaled(rows, ratio)
    share = np.where(labels == 1, ones, len(labels) - ones) / len(labels)
    weights, bias = dual_descent(rows, values, np.where(labels == 1, 1.0, -1.0), COST * 0.5 / share)
    margin = np.array([weights[row] @ value + bias for row, value in zip(rows, values)])
    slope, intercept = logistic(margin, labels)
    return Model(np.stack([ratio, weights]).astype(np.float32), bias, slope, intercept)


def margin_of(row: np.ndarray, model: Model) -> float:
    if model.weights.ndim == 1 or not len(row):
        return model.bias
    ratio = model.weights[0][row].astype(float)
    length = np.sqrt(ratio @ ratio)
    return float(model.weights[1][row] @ ratio) / (length or 1.0) + model.bias


def fit(documents: DataFrame, labels: DataFrame, train: Column, max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most about ``max_rows`` labelled documents for which ``train`` (on doc_id) holds.

    The n-grams of the sample are found where its texts lie; one task fits on them and returns
    the model: two vectors of SLOTS numbers, whatever the size of the tables.
    """
    sample = labelled_sample(documents, labels, "quality", train, max_rows).where(F.col("label").isin(0, 1))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [indicators(text).astype(np.int32) for text in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32())), batch.column("label")], names=["doc_id", "slots", "label"]
            )

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "label"], kind="stable")
        model = fit_rows([np.asarray(s) for s in frame["slots"]], frame["label"].to_numpy())
        kind = {"weights": [model.weights.tobytes()], "bias": model.bias, "slope": model.slope, "intercept": model.intercept}
        return pd.DataFrame(kind)

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = materialise(sample.mapInArrow(find, f"doc_id {kind}, slots array<int>, label int"))
    model = found.groupBy().applyInPandas(learn, "weights binary, bias double, slope double, intercept double").first()
    if model is None:
        return fit_rows([], np.zeros(0))
    weights = np.frombuffer(bytes(model["weights"]), np.float32)
    return Model(weights.reshape(-1, SLOTS).squeeze(), model["bias"], model["slope"], model["intercept"])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, margin, score): one row for each document; a null text counts as empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [margin_of(indicators(text), model) for text in byte_values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(margins, pa.float64())], names=["doc_id", "margin"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    logit = F.col("margin") * model.slope + model.intercept
    found = documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, margin double")
    return found.withColumn("score", 1 / (1 + F.exp(-logit)))


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column, for filters that keep all other columns where they are."""

    def margins(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([margin_of(indicators(value), model) for value in byte_values(batch)], pa.float64())

    logit = F.arrow_udf(margins, "double")(text) * model.slope + model.intercept
    return 1 / (1 + F.exp(-logit))
