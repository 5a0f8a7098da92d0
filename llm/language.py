"""Language identification by a string kernel.

Two texts are as alike as the n-grams of 1 to N characters that occur in both
(presence, not counts, blended over the lengths), divided by the square root of what
each has in common with itself. Landmark texts stand for the training texts
(Nystroem): a text is described by its kernel values with the landmarks, whitened by
the landmarks' own kernel matrix, and one ridge regression per language on these
features separates it from the rest.

For scoring, everything behind the n-gram indicators is linear up to the text's own
norm, so the landmark indicators, the whitening and the regressions fold into one
matrix of n-grams by languages. A batch of texts is one product with that matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: N-grams of one to so many characters; three code points fit into 64 bits.
LONGEST = 3
UNDETERMINED = "und"
#: Bounds of the fit: training texts per language, and landmarks among them.
PER_LANGUAGE, LANDMARKS = 250, 48
SHARES = 32
RIDGE = 1e-3
#: Characters whose n-grams are sorted at a time.
_PIECE = 1 << 20


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text, sorted, as numbers; cases are folded."""
    parts = []
    folded = text.lower()
    for start in range(0, max(1, len(folded)), _PIECE):
        piece = folded[start : start + _PIECE + LONGEST - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        gram = codes
        parts.append(gram)
        for n in range(1, LONGEST):
            gram = gram[:-1] << np.uint64(21) | codes[n:]
            if gram.size:
                parts.append(gram)
    joined = np.sort(np.concatenate(parts))
    if not joined.size:
        return joined
    return joined[np.concatenate(([True], joined[1:] != joined[:-1]))]


def kernel(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> np.ndarray:
    """Normalised kernel values of two lists of n-gram sets."""
    known = np.unique(np.concatenate(list(b)))
    right = _indicators(b, known)
    norms = np.sqrt(np.outer([max(1, x.size) for x in a], [max(1, x.size) for x in b]))
    return (_indicators(a, known) @ right.T) / norms


def _indicators(sets: Sequence[np.ndarray], known: np.ndarray) -> np.ndarray:
    found = np.zeros((len(sets), len(known)), dtype=np.float32)
    for row, own in enumerate(sets):
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        found[row, at[known[at] == own]] = 1
    return found


@dataclass(frozen=True)
class Model:
    """What scoring needs: known n-grams, their weight for each language, intercepts."""

    languages: tuple[str, ...]
    known: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray

    def predict(self, texts: Sequence[str | None], batch: int = 64) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` and 0 without any letter.

        The score is the regression's value for the language found, cut to 0..1.
        """
        names: list[str] = []
        scores: list[float] = []
        for start in range(0, len(texts), batch):
            part = texts[start : start + batch]
            some = [t if t and any(map(str.isalpha, t)) else None for t in part]
            sets = [grams(t) if t else np.empty(0, dtype=np.uint64) for t in some]
            if not self.languages:
                names += [UNDETERMINED] * len(part)
                scores += [0.0] * len(part)
                continue
            norms = np.sqrt([max(1, own.size) for own in sets])[:, None]
            values = (_indicators(sets, self.known) @ self.weights) / norms + self.intercepts
            best = values.argmax(axis=1)
            for row, text in enumerate(some):
                names.append(self.languages[best[row]] if text else UNDETERMINED)
                scores.append(float(min(1.0, max(0.0, values[row, best[row]]))) if text else 0.0)
        return names, scores


def fit(texts: Sequence[str], languages: Sequence[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a sample in memory. ``landmarks`` of each language, the first ones, are kept."""
    sets = [grams(t) for t in texts]
    labels = tuple(sorted(set(languages)))
    if not labels:
        return Model((), np.empty(0, dtype=np.uint64), np.empty((0, 0)), np.empty(0))
    seen: dict[str, int] = {}
    chosen = []
    for row, label in enumerate(languages):
        seen[label] = seen.get(label, 0) + 1
        if seen[label] <= landmarks and sets[row].size:
            chosen.append(row)
    marks = [sets[row] for row in chosen] or [np.array([1], dtype=np.uint64)]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    large = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, large] / np.sqrt(values[large])
    features = kernel(sets, marks).astype(np.float64) @ whiten
    target = np.array([[float(label == name) for name in labels] for label in languages])
    middle, mean = features.mean(axis=0), target.mean(axis=0)
    centred = features - middle
    gram = centred.T @ centred + ridge * len(sets) * np.eye(centred.shape[1])
    slopes = np.linalg.solve(gram, centred.T @ (target - mean))
    known = np.unique(np.concatenate(marks))
    by_mark = (whiten @ slopes) / np.sqrt([max(1, m.size) for m in marks])[:, None]
    weights = (_indicators(marks, known).T.astype(np.float64) @ by_mark).astype(np.float32)
    return Model(labels, known, weights, mean - middle @ slopes)


def training_sample(df: DataFrame, key: str, text: str, label: str, per_label: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_label`` texts of each language, those with the lowest hash of the key.

    Only keys and labels are ranked, in shares and then as a whole, and Spark cuts each
    partition to the wanted number before the exchange; the texts of the chosen keys are then fetched. Of rows that share a
    key and a label, the first text in order stands for all.
    """
    order = Window.partitionBy("label").orderBy("draw", "key")
    in_share = Window.partitionBy("label", "share").orderBy("draw", "key")
    ranked = (
        df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).alias("key"), F.col(label).alias("label"), F.xxhash64(F.col(key)).alias("draw"))
        .distinct()
        # A label's candidates grow with the partitions. They are ranked in shares first, so that the task
        # with all of a label's gets per_label from each share, however many partitions there are.
        .withColumn("share", F.pmod("draw", F.lit(SHARES)))
        .withColumn("place", F.row_number().over(in_share))
        .where(F.col("place") <= per_label)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= per_label)
    )
    chosen = ranked.select("key", "draw").distinct()
    rows = (
        df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label"))
        # per_label rows for each language: bounded by the two parameters.
        .join(F.broadcast(chosen), "key")
        # Rows that share a key count once, so that what comes to the driver is bounded as well.
        .groupBy("key", "draw", "label")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r.draw, r.text, r.label))
    return [(r.text, r.label) for r in rows]


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows; without any, every text is ``und``."""
    sample = training_sample(df, key, text, label, per_label)
    return fit([t for t, _ in sample], [name for _, name in sample])


def predictor(df: DataFrame, model: Model):
    """A function from a text column to a struct (lang_pred, score)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        names, scores = shipped.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return predict


def language_of(df: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """The predicted language and score of a text column, as a struct."""
    return predictor(df, model)(F.col(text) if isinstance(text, str) else text)
