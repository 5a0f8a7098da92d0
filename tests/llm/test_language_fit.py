"""Language ID against plain arithmetic, and its sample against a plain ranking."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import language

WORDS = {"fr": "le chat noir la maison bleue sur une table avec du pain", "en": "the black cat a blue house upon some table with bread", "de": "die schwarze katze ein blaues haus auf dem tisch mit brot"}


def texts_of(count, seed):
    draw = np.random.default_rng(seed)
    names = [list(WORDS)[i % 3] for i in range(count)]
    return [" ".join(draw.choice(WORDS[name].split(), 5)) for name in names], names


def plain_kernel(a, b):
    def grams(text):
        text = text.lower()
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    return np.array([[len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y))) for y in b] for x in a])


def test_scores_are_those_of_kernel_ridge():
    """The dual form: no folded weights, no whitening, one explicit kernel."""
    texts, names = texts_of(60, 1)
    model = language.fit(texts, names, landmarks=6, ridge=1e-2)
    marks = [t for name in WORDS for t in [t for t, n in zip(texts, names) if n == name][:6]]
    inverse = np.linalg.pinv(plain_kernel(marks, marks), rcond=1e-6, hermitian=True)
    asked = [*texts_of(30, 2)[0], "zzz", "q", "Le Chat"]

    def gram(a, b):
        return plain_kernel(a, marks) @ inverse @ plain_kernel(b, marks).T

    own, middle = gram(texts, texts), np.eye(60) - 1 / 60
    labels = sorted(WORDS)
    target = np.array([[float(n == label) for label in labels] for n in names])
    dual = np.linalg.solve(middle @ own @ middle + 1e-2 * 60 * np.eye(60), target - target.mean(axis=0))
    values = target.mean(axis=0) + (gram(asked, texts) - own.mean(axis=0)) @ middle @ dual
    found, scores = model.predict(asked)
    assert model.languages == tuple(labels)
    assert found == [labels[i] for i in values.argmax(axis=1)]
    np.testing.assert_allclose(scores, np.clip(values.max(axis=1), 0, 1), atol=1e-4)


@pytest.mark.parametrize("per_label", [1, 7, 400])
def test_the_sample_is_the_lowest_draws_of_each_label(spark, per_label):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
        F.when(F.col("id") % 3 > 0, "en").when(F.col("id") % 9 > 0, "fr").when(F.col("id") % 5 > 0, "de").alias("lang"),
        F.lit(1).alias("share"),
        F.lit(2).alias("place"),
    ).repartition(40)
    drawn = rows.where("lang is not null").withColumn("draw", F.xxhash64("doc_id")).collect()
    want = collections.defaultdict(dict)
    for r in sorted(drawn, key=lambda r: (r.draw, r.doc_id is not None, r.doc_id or 0)):
        of_label = want[r.lang]
        if r.doc_id is not None and len(of_label) < per_label:
            of_label[r.doc_id] = r.text
    got = language.training_sample(rows, "doc_id", "text", "lang", per_label)
    counts = collections.Counter(label for _, label in got)
    for label, texts in want.items():
        mine, lowest = [t for t, name in got if name == label], list(texts.values())
        # Rows without a key may take one place of a label, and bring no text.
        assert mine in (lowest, lowest[:-1]) and counts[label] <= per_label
