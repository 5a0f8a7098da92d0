"""Quality classification by naive Bayes support vectors.

Features are indicators of word n-grams, each scaled by its log-count ratio between
the two classes; a linear hinge-loss model on them is fitted by dual coordinate
descent, and a logistic curve turns its margins into scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import word_blocks

#: Bound of the fit: labelled rows read.
SAMPLE = 4000
#: An n-gram counts if it occurs in so many sampled texts.
LEAST_TEXTS = 3
COST, ROUNDS, SMOOTHING = 1.0, 30, 1.0
#: Stands for a word that repeats the word before it.
_AGAIN = b"\x00"


def ngrams(text: str | None) -> set[bytes]:
    """The distinct one- and two-word n-grams of a text.

    A word equal to the one before is written as a mark of its own, so that repetition
    is a feature whatever the word. A null or empty text has one n-gram, the empty one.
    """
    found: set[bytes] = set()
    seen = 0
    for block in word_blocks(text, carry=2):
        marked = [_AGAIN if b == a else b for a, b in zip(block, block[1:])]
        if seen < 2:
            # All words so far have been carried on: the block begins with the text's first word.
            marked = block[:1] + marked
        seen += len(block) - min(seen, 2)
        found.update(marked)
        found.update(map(b" ".join, set(zip(marked, marked[1:]))))
    return found or {b""}


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float]
    intercept: float
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        """The probability of class 1. Empty texts have a score too."""
        get = self.weights.get
        hit = [w for gram in ngrams(text) if (w := get(gram)) is not None]
        margin = sum(sorted(hit)) / max(1.0, len(hit)) ** 0.5 + self.intercept
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def _descend(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, rounds: int) -> np.ndarray:
    """Weights (intercept last) of the hinge loss, by dual coordinate descent."""
    weights = np.zeros(len(ratio) + 1)
    scaled = [np.append(ratio[own] / max(1, own.size) ** 0.5, 1.0) for own in rows]
    index = [np.append(own, len(ratio)) for own in rows]
    norms = [float(x @ x) for x in scaled]
    duals = np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in draw.permutation(len(rows)):
            slope = signs[i] * (weights[index[i]] @ scaled[i]) - 1.0
            new = min(cost, max(0.0, duals[i] - slope / norms[i]))
            step = new - duals[i]
            if step:
                weights[index[i]] += step * signs[i] * scaled[i]
                duals[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4 * cost:
            break
    return weights


def _curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, with smoothed targets, by Newton steps."""
    high, low = positive.sum(), (~positive).sum()
    target = np.where(positive, (high + 1) / (high + 2), 1 / (low + 2))
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    at = np.array([1.0, 0.0])

    def loss(x):
        z = design @ x
        return np.logaddexp(0, z).sum() - target @ z + 1e-3 * x @ x

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        gradient = design.T @ (p - target) + 2e-3 * at
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 2e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(texts: Sequence[str | None], labels: Sequence[int], cost: float = COST, rounds: int = ROUNDS) -> Model:
    """Fit on texts in memory. With one class only the score is its smoothed share."""
    positive = np.array([label == 1 for label in labels], dtype=bool)
    if not len(labels) or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(labels) + 2)
        return Model({}, 0.0, 0.0, float(np.log(share / (1 - share))))
    # Counted by hash: the n-grams themselves, nearly all of which occur once, would fill
    # the driver. Only those that occur often enough are kept.
    digest = xxhash.xxh64_intdigest
    every = np.sort(np.concatenate([np.array([digest(g) for g in ngrams(t)], dtype=np.uint64) for t in texts]))
    least = every[LEAST_TEXTS - 1 :]
    frequent = set(np.unique(least[least == every[: len(least)]]).tolist())
    del every, least
    number: dict[bytes, int] = {}
    rows = [
        np.array(sorted(number.setdefault(g, len(number)) for g in sorted(ngrams(t)) if digest(g) in frequent), dtype=np.int64)
        for t in texts
    ]
    vocabulary = list(number)
    size = len(vocabulary)

    def ratio_of(chosen) -> np.ndarray:
        up, down = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
        for i in chosen:
            (up if positive[i] else down)[rows[i]] += 1
        return np.log(up / up.sum()) - np.log(down / down.sum())

    def weights_of(chosen) -> tuple[np.ndarray, np.ndarray]:
        ratio = ratio_of(chosen)
        return _descend([rows[i] for i in chosen], signs[chosen], ratio, cost, rounds), ratio

    def margins_of(chosen, weights, ratio) -> np.ndarray:
        own = ratio * weights[:-1]
        return np.array([own[rows[i]].sum() / max(1, rows[i].size) ** 0.5 + weights[-1] for i in chosen])

    signs = np.where(positive, 1.0, -1.0)
    everything = np.arange(len(rows))
    margins = np.zeros(len(rows))
    for fold in range(3):
        rest, part = everything[everything % 3 != fold], everything[everything % 3 == fold]
        if rest.size and part.size:
            margins[part] = margins_of(part, *weights_of(rest))
    slope, offset = _curve(margins, positive)
    weights, ratio = weights_of(everything)
    own = ratio * weights[:-1]
    kept = {gram: float(w) for gram, w in zip(vocabulary, own)}
    return Model(kept, float(weights[-1]), slope, offset)


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> Model:
    """Fit on at most ``sample`` labelled documents, those with the lowest hash of the key.

    Labels other than 0 and 1 are ignored, and equal labels of a document count once. The
    keys are drawn from the labels alone; the texts of these few are then fetched. Of
    documents that share a key, the first text in order stands for all.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1))
        .select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key)).alias("draw"))
        .distinct()
        .orderBy("draw", "key", "label")
        .limit(sample)
    )
    rows = (
        documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
        # At most ``sample`` rows.
        .join(F.broadcast(chosen), "key")
        # Documents that share a key count once: no more rows than labels come to the driver.
        .groupBy("key", "draw", "label")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r.draw, r.key, r.text or "", r.label))
    return fit([r.text for r in rows], [r.label for r in rows])


def quality_of(df: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([shipped.value.score(t) for t in texts], dtype="float64")

    return score(F.col(text) if isinstance(text, str) else text)
