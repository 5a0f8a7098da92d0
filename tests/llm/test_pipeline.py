"""Each stage's decisions, on what the one before kept."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from llm import quality, simhash
from llm.queries import GOOD

from . import tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("steps")
    found = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found.append(docs)
    return found


def test_columns_and_ids(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()


def test_filters_keep_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1")
    assert steps[1].count() > 0.98 * steps[0].count()
    kept = steps[2].join(good, "doc_id").count()
    assert kept > 0.95 * steps[1].join(good, "doc_id").count()
    bad = labels.where("quality = 0")
    assert steps[2].join(bad, "doc_id").count() < 0.3 * steps[1].join(bad, "doc_id").count()


def test_one_of_each_group_stays(steps):
    before, after = steps[2].collect(), {r.doc_id for r in steps[3].collect()}
    fps = {r.doc_id: simhash.simhash(r.text) for r in before}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {i for i in ids if find(i) == i}


def test_mix_and_encoding(steps):
    copies = collections.Counter(r.doc_id for r in steps[4].collect())
    assert max(copies.values()) <= 2 and copies.keys() <= {r.doc_id for r in steps[3].collect()}
    assert collections.Counter(r.doc_id for r in steps[5].collect()) == copies
    decoded = {(r.doc_id, r.d) for r in steps[4].select("doc_id", F.sha2("text", 256).alias("d")).collect()}
    assert decoded == {(r.doc_id, r.decoded_sha256) for r in steps[5].collect()}


def test_run_is_the_stages(spark, steps):
    whole = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, SF).collect())
    assert whole == collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in steps[5].collect())


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, tmp_path, empty, monkeypatch):
    monkeypatch.setattr(quality.Model, "score", lambda self, text: GOOD)
    folder = tables.written(spark, tmp_path, empty)
    rows = pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    assert not rows if empty else ids and not ids & {2, 3, 4, 7} and 6 not in ids


def test_repeated_ids_stay_once(spark):
    docs = tables.documents(spark)
    rows = pipeline.drop_near_duplicates(spark, docs, "").collect()
    counts = collections.Counter(r.doc_id for r in rows)
    assert counts[7] == 1 and counts[None] == 1 and counts[0] == 1 and counts[6] == 0
