"""The pipeline's near duplicates, against brute force on edited copies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from llm import simhash


def edited(seed: int = 1) -> list[tuple[int, str]]:
    """Texts of 5 to 300 words, their copies with some words replaced, and copies of copies."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = []
    for _ in range(60):
        text = [word() for _ in range(draw.choice((5, 20, 100, 300)))]
        texts.append(text)
        for _ in range(draw.randrange(6)):
            text = list(draw.choice((text, texts[-1])))
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = word()
            texts.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def groups_of(rows: list[tuple[int, str]]) -> dict[int, int]:
    prints, root = [(i, simhash.simhash(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_stage_keeps_one_of_each_group(spark):
    rows = edited()
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    expected = groups_of(rows)
    assert len(set(expected.values())) < len(rows) - 20
    kept = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(expected.values()))


def test_repeated_and_missing_ids(spark):
    """Different texts under one id stay; copies go under any id, and without one."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(9, one), (9, two), (8, one.upper()), (None, two), (None, three), (None, three), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    found = pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    kept = [(r.doc_id, (r.text or "").lower()) for r in found.collect()]
    assert sorted(kept, key=str) == sorted([(8, one), (9, two), (None, three), (5, "")], key=str)


@pytest.mark.parametrize("names", [["row", "doc", "name", "fp", "component_id"], ["__row", "__key", "__n", "__times", "__copy"]])
def test_columns_of_any_name_stay(spark, names):
    rows = [(1, "a b c d", "en", "s"), (2, "a b c d", "en", "s"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({n: F.lit(n) for n in names})
    for stage, ids in ((pipeline.drop_near_duplicates, {1, 3}), (pipeline.mix_sources, None)):
        found = stage(spark, docs, "")
        assert found.columns == docs.columns
        rows = found.collect()
        assert all(r[n] == n for r in rows for n in names) and (ids is None or {r.doc_id for r in rows} == ids)
