"""Toxic passages: maximum-scoring segments of token log-odds, with extreme-value calibration.

Each token has a score: the log-odds of its use in toxic against other documents, under an
informative Dirichlet prior (Monroe et al., 2008), if that differs from zero significantly, less a
drift. A word without a score of its own has that of its stem, its first letters, so that inflected forms count. All maximal scoring segments of a text are found in linear time (Ruzzo and Tompa, 1999). A
segment's significance follows Karlin and Altschul (1990): K n exp(-lambda S) segments as good are expected by chance
in n clean tokens. The evidence of a document is the sum over its significant segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribospark.llm.text import labelled_sample, text_values
from tribospark.session import materialise

TOKEN = re.compile(r"\w+")
#: Letters of a stem. Shorter words are their own stems.
STEM = 5
#: Labelled documents to learn from, at most about.
TRAIN_ROWS = 20_000
#: Total mass of the prior as a share of all counts, dealt by each token's frequency in all training documents.
PRIOR_SHARE = 0.1
#: A token has a score of its own from this many standard errors, and from these log-odds (twelve times as
#: frequent): copies of one document make weaker differences look significant.
SIGNIFICANT, STRONG = 3.0, 2.5
#: What every token loses, so that chance segments end.
DRIFT = 0.05
#: The constant of the chance law where clean texts don't tell it.
KARLIN_K = 0.1


@dataclass(frozen=True)
class Model:
    """What scoring needs: a lexicon, the law of chance segments, and the logistic calibration."""

    lexicon: dict[str, float]
    stems: dict[str, float]
    decay: float
    intercept: float = 0.0
    slope: float = 0.0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """(first, last + 1, score) of all maximal scoring segments, in one pass.

    ``scores`` holds (position, score) of the tokens that have one; the others lose ``drift`` each, and
    a run of them counts as one step. Every candidate keeps the running total before and after it.
    """
    found: list[list] = []  # [first, last + 1, total before, total after, nearest one with a lower total before]
    total, at = 0.0, 0
    for position, score in scores:
        total -= drift * (position - at)
        at = position + 1
        before = total
        total += score - drift
        if total <= before:
            continue
        new = [position, at, before, total]
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= new[2]:
                k = found[k][4]
            if k < 0 or found[k][3] >= new[3]:
                found.append([*new, k])
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            nearest = found[k][4]
            del found[k:]
            k = nearest
    return [(a, b, after - before) for a, b, before, after, _ in found]


def chance_decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(x * scores)) = sum(weights); at most 50."""

    def over(x: float) -> float:
        return float((weights * np.expm1(np.minimum(x * scores, 600.0))).sum())

    if (weights * scores).sum() >= 0:
        return 1e-3
    low, high = 1e-6, 50.0
    if over(high) < 0:
        return high
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) < 0 else (low, middle)
    return high


def passages(text: str, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of tokens, and (first token, last + 1, evidence) of every significant passage.

    Evidence is the Gumbel variate lambda S - ln(K n): positive if fewer than one such passage is
    expected by chance in a clean text of this length.
    """
    words = tokens(text)
    word, stem = model.lexicon.get, model.stems.get
    hits = [(i, s) for i, w in enumerate(words) if (s := word(w)) is not None or (s := stem(w[:STEM])) is not None]
    if not hits:
        return len(words), []
    chance = np.log(max(KARLIN_K * len(words), 1.0))
    scored = [(a, b, model.decay * s - chance) for a, b, s in segments(hits, DRIFT)]
    return len(words), [(a, b, e) for a, b, e in scored if e > 0]


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, stem, toxic, clean): documents of each class that hold the token, or a word of the stem; pre-aggregated per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {(stem, label): Counter() for stem in (False, True) for label in (0, 1)}
            for text, label in zip(text_values(batch.column("text")), batch.column("label").to_pylist()):
                words = set(tokens(text))
                by[False, label].update(words)
                by[True, label].update({w[:STEM] for w in words})
            for (stem, label), counts in by.items():
                n = list(counts.values())
                zero = [0] * len(n)
                columns = [list(counts), [stem] * len(n), n if label else zero, zero if label else n]
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["token", "stem", "toxic", "clean"])

    pairs = sample.where(F.col("label").isin(0, 1)).select("text", "label")
    counted = pairs.mapInArrow(count, "token string, stem boolean, toxic bigint, clean bigint")
    return counted.groupBy("token", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame) -> Model:
    """Significant tokens and stems with their log-odds, and the decay of chance segments in clean texts.

    Only significant tokens come to the driver: they are a part of the sample's vocabulary, which
    TRAIN_ROWS bounds.
    """
    sums = counts.where("not stem").agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = float(sums[0] or 0), float(sums[1] or 0)
    if not n_toxic or not n_clean:
        return Model({}, {}, 1.0)
    mass = PRIOR_SHARE * (n_toxic + n_clean)
    prior = PRIOR_SHARE * (F.col("toxic") + F.col("clean"))
    one, other = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(one / (n_toxic + mass - one)) - F.log(other / (n_clean + mass - other))
    error = F.sqrt(1 / one + 1 / other)
    kept = counts.select("token", "stem", "clean", odds.alias("odds"), error.alias("error"))
    kept = kept.where(F.abs("odds") >= F.greatest(SIGNIFICANT * F.col("error"), F.lit(STRONG))).toPandas()
    kept = kept.sort_values("token")
    words, stems = kept[~kept["stem"]], kept[kept["stem"]]
    scores = np.append(words["odds"].to_numpy() - DRIFT, -DRIFT)
    seen = words["clean"].to_numpy() + 0.5
    weights = np.append(seen, max(n_clean - seen.sum(), 1.0))
    scored_words, scored_stems = (dict(zip(k["token"], k["odds"].astype(float))) for k in (words, stems))
    return Model(scored_words, scored_stems, chance_decay(scores, weights / weights.sum()))


def evidence(texts: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns, n_tokens, passages (first, last, evidence), and their summed evidence."""
    fields = [f for f in texts.schema.fields if f.name in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, total = [], [], []
            for text in text_values(batch.column("text")):
                size, spans = passages(text, model)
                n.append(size)
                found.append([{"first": a, "last": b - 1, "evidence": e} for a, b, e in spans])
                total.append(sum(e for *_, e in spans))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))
            columns = [*(batch.column(f.name) for f in fields), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), "n_tokens", "passages", "evidence"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    result = f"{kinds}, n_tokens bigint, passages array<struct<first:int,last:int,evidence:double>>, evidence double"
    return texts.select("text", *(f.name for f in fields)).mapInArrow(scan, result)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a lightly penalised logistic curve, by Newton's method."""
    if not len(x):
        return 0.0, 0.0
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        step = np.linalg.solve((design * w[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(documents: DataFrame, labels: DataFrame, train: Column, max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled documents for which ``train`` (on doc_id) holds.

    Without labels of both classes the model scores every document 0.5 or by the known class only.
    """
    sample = materialise(labelled_sample(documents, labels, "toxic", train, max_rows))
    model = lexicon(materialise(token_counts(sample)))
    known = evidence(sample, model, "label").select("label", "evidence").toPandas()  # max_rows at most, about
    known = known.sort_values(["evidence", "label"])
    x = np.log1p(known["evidence"].to_numpy(float))
    intercept, slope = logistic(x, known["label"].to_numpy(float))
    return replace(model, intercept=intercept, slope=slope)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, passages, score): one row for each document; a null text counts as empty."""
    logit = F.log1p("evidence") * model.slope + model.intercept
    found = evidence(documents.select("doc_id", "text"), model, "doc_id")
    return found.select("doc_id", "n_tokens", "passages", (1 / (1 + F.exp(-logit))).alias("score"))


def score_of(text: Column, model: Model) -> Column:
    """The score of a text column, for filters that keep all other columns where they are."""

    def totals(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([sum(e for *_, e in passages(value, model)[1]) for value in text_values(batch)], pa.float64())

    logit = F.log1p(F.arrow_udf(totals, "double")(text)) * model.slope + model.intercept
    return 1 / (1 + F.exp(-logit))
