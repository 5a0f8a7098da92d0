"""Every query on awkward tables, on empty ones, and against SQL or a plain version."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from llm import ann, chat, ctph, katz, language, mixing, quality, queries as q, simhash, warc
from llm.common import fold_of

from . import tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return tables.written(spark, tmp_path_factory.mktemp("awkward"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables.written(spark, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", list(q.queries()))
def test_empty_tables(spark, empty, name):
    rows = q.queries()[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "op7_chat" else rows == []


@pytest.mark.parametrize("name", [n for n in q.queries() if n not in ("op2_warc", "op4_hilbert_neighbours", "op7_chat", "op11_hard_negatives", "op12_collocations")])
def test_one_row_per_document(spark, awkward, name):
    rows = q.queries()[name](spark, awkward).collect()
    want = sorted(r.doc_id is None or r.doc_id for r in tables.documents(spark).select("doc_id").collect())
    assert sorted(r.doc_id is None or r.doc_id for r in rows) == want


@pytest.mark.parametrize("name", list(q.oracle_sql()))
@pytest.mark.parametrize("where", ["awkward", SF])
def test_sql(spark, awkward, name, where):
    folder = awkward if where == "awkward" else where
    assert difference(q.queries()[name](spark, folder).toPandas(), tables.sql(folder, q.oracle_sql()[name])) is None


def _components(fps: dict, radius: int = 3) -> dict:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in q.op1_simhash(spark, SF).collect()}
    fps = {r.doc_id: simhash.simhash(r.text) for r in docs.collect()}
    assert {i: r.component_id for i, r in found.items()} == _components(fps)
    assert all(found[i].fingerprint == f"{fp:016x}" for i, fp in fps.items())


def test_simhash_awkward(spark, awkward):
    found = {(r.doc_id, r.fingerprint): r.component_id for r in q.op1_simhash(spark, awkward).collect()}
    zero = "0" * 16
    assert found[2, zero] == found[3, zero] == found[4, zero] == 2
    assert {c for (i, _), c in found.items() if i in (0, 6)} == {0}
    assert {c for (i, _), c in found.items() if i is None} == {None}


def test_simhash_large_buckets_are_dealt_again(spark):
    """6000 fingerprints that agree in 51 bits: one chain, and one bucket at first."""
    base = np.int64(0x5DEECE66D1234567) & ~np.int64(0x1FFF)
    fps = spark.createDataFrame([(int(base + i),) for i in range(6000)] + [(int(~base),)], "fp long")
    roots = simhash.connected(simhash.links_of(fps)).collect()
    assert len(roots) == 5999 and {r.root for r in roots} == {int(base)}


def test_connected_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 800)], "high long, low long")
    found = {r.node: r.root for r in simhash.connected(links).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 900: 800}


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in q.op3_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 100 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95


def test_language_awkward(spark, awkward):
    rows = {(r.doc_id, r.lang_pred): r.score for r in q.op3_language_id(spark, awkward).collect()}
    assert all(rows[i, "und"] == 0 for i in (2, 3, 4, 7))


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in q.op10_nbsvm_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    good = [r.score for r in rows if truth[r.doc_id] == 1]
    bad = [r.score for r in rows if truth[r.doc_id] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all((r.score >= 0.7) == (r.predicted == 1) for r in rows)


def _plain_neighbours(rows: dict, k: int = 5) -> dict:
    ids = sorted(rows)
    unit = np.array([np.array(rows[i], float) / np.linalg.norm(np.array(rows[i], float)) for i in ids])
    found = {}
    for at, i in enumerate(ids):
        if i % 50 == 0:
            scores = np.round(unit @ unit[at], 12)
            found[i] = [ids[j] for j in np.lexsort((ids, -scores)) if j != at][:k]
    return found


def test_neighbours_recall(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = collections.defaultdict(list)
    for r in q.op4_hilbert_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    want = _plain_neighbours(rows)
    assert found.keys() == want.keys()
    assert np.mean([len(set(found[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_neighbours_small_windows(spark):
    """With structure in the vectors, narrow stretches are enough."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 16))
    rows = {i: (centres[i % 60] + 0.05 * draw.normal(size=16)).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    vectors = ann.distinct_vectors(df, "vec_id", "embedding", 5, F.col("vec_id") % 50 == 0)
    width = ann.window_width(vectors, ann._places(vectors, ann.CURVES, ann.DIMENSIONS, ann.BITS), 5)
    assert width < 300
    found = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, tile=64).collect():
        found[r.query_id].add(r.vec_id)
    want = _plain_neighbours(rows)
    assert np.mean([len(found[i] & set(want[i])) / 5 for i in want]) >= 0.9


def test_neighbours_awkward(spark, awkward):
    found = collections.defaultdict(list)
    for r in q.op4_hilbert_neighbours(spark, awkward).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    # 50 twice, with two vectors; 200 and 250 take no part.
    assert set(found) == {0, 50, 100, 150, 300}
    assert [i for i, _ in found[0]][:2] == [150, 300] and found[0][0][1] == pytest.approx(1)
    assert [i for i, _ in found[150]][:2] == [0, 300]
    assert all(len(v) == 5 and all(i != k for i, _ in v) for k, v in found.items())


def test_bpe_columns(spark, awkward):
    from llm import bpe

    docs = tables.documents(spark)
    coded = bpe.decode(bpe.encode(docs, *q.vocabulary()), *q.vocabulary()).collect()
    digests = {(r.doc_id, r.decoded_sha256): r for r in q.op5_byte_bpe(spark, awkward).collect()}
    for r in coded:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw
        own = digests[r.doc_id, hashlib.sha256(raw).hexdigest()]
        assert own.n_tokens == len(r.ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()


def test_mix_rows(spark):
    docs = tables.documents(spark)
    taken = mixing.copies(docs).collect()
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    want = collections.Counter()
    for r in taken:
        assert 0 <= r.copies <= 2
        want[r.doc_id] += r.copies
    assert counts == +want


def test_mix_of_a_key_on_many_rows(spark):
    """Null keys and one repeated key on most rows: their copies are shared out along the rows."""
    docs = spark.range(400).select(
        F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, -1).alias("doc_id"),
        F.format_string("word %d", F.col("id") % 50).alias("text"), F.lit("a").alias("source"), F.col("id").alias("turn"),
    )
    taken = collections.Counter()
    for r in mixing.copies(docs).collect():
        taken[r.doc_id] += r.copies
    rows = mixing.mixed(docs).collect()
    assert collections.Counter(r.doc_id for r in rows) == +taken
    # A row is taken as often as the others of its key, or once more.
    for key, of_key in ((None, 200), (-1, 100)):
        times = collections.Counter(r.turn for r in rows if r.doc_id == key)
        assert set(times.values()) <= {taken[key] // of_key, taken[key] // of_key + 1}


def test_samples_of_a_key_on_many_rows(spark):
    docs = spark.range(500).select(F.lit(7).cast("bigint").alias("doc_id"), F.format_string("text %03d", "id").alias("text"), F.lit("en").alias("lang"))
    assert language.training_sample(docs, "doc_id", "text", "lang") == [("text 000", "en")]
    labels = spark.createDataFrame([(7, 1)] * 3, "doc_id long, quality int")
    # One text of class 1: the smoothed share is 2 / 3.
    assert quality.train(docs, labels).score("anything") == pytest.approx(2 / 3)


def test_mix_is_near_its_targets_whatever_the_slices(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id * 7919 % 50 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    by_source = mixing.copies(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")
    )
    assert all(abs(r.taken - r.target) <= 100 for r in by_source.collect())


def test_native_mix_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_chat_whole_texts(spark, awkward):
    rows = tables.conversations(spark).withColumn("record", F.to_json(F.struct("role", "text")))
    parts = chat.pieces(rows, ["conv_id", "turn"])
    whole = {r.conv_id: r.formatted for r in chat.formatted(parts, "conv_id", ["turn"]).collect()}
    assert [t for t in chat.parse(whole[1])] == [("user", "first"), ("assistant", "second"), ("assistant", "third <|im_end|>\n</s>")]
    assert {r.conv_id: r.formatted_chars for r in chat.read_back(parts, "conv_id", ["turn"]).collect()} == {k: len(v) for k, v in whole.items()}


def test_warc_payloads(spark):
    pages = tables.pages(spark).repartition(3)
    from stockloom.sources.scratch import new_path

    manifest = warc.write(pages, new_path(spark, "warc"))
    read = {r.record_id: r for r in warc.read(manifest, range_bytes=700).collect()}
    assert len(read) == 9
    assert bytes(read["<urn:page:7>"].payload).decode() == tables.LONG and read["<urn:page:6>"].payload is None
    assert read["<urn:page:1>"].refers_to == read["<urn:page:2>"].refers_to == "<urn:page:8>"
    assert bytes(read["<urn:page:5>"].payload) == b"" and read["<urn:page:4>"].record_type == "revisit"


def test_warc_files_are_held_against_the_manifest(spark):
    from stockloom.sources.scratch import new_path

    manifest = warc.write(tables.pages(spark).repartition(3), new_path(spark, "warc"))
    records = warc.read(manifest, payload=False, range_bytes=700)
    # Adaptive execution does not merge the tasks that read.
    assert records.rdd.getNumPartitions() > 1
    warc.complete(records, manifest)
    with pytest.raises(ValueError, match="records were read"):
        warc.complete(records, manifest.withColumn("records", F.col("records") + 1))
    with pytest.raises(Exception, match="but the manifest has"):
        warc.read(manifest.withColumn("bytes", F.col("bytes") + 1)).collect()
    assert warc.read(manifest.limit(0)).count() == 0


def _plain_katz(docs, training):
    texts = [(t or "").encode().lower().split() + [b" end"] for _, t in docs]
    one, two, follows = collections.Counter(), collections.Counter(), collections.Counter()
    for (i, _), words in zip(docs, texts):
        if training(i):
            for h, w in zip([b" begin", *words], words):
                one[w] += 1
                two[h, w] += 1
                follows[h] += 1

    def discounts(counts):
        of = collections.Counter(counts.values())
        return katz.good_turing(sum(counts.values()), len(counts), [of[r] for r in range(1, 7)])

    words_, pairs = discounts(one), discounts(two)
    total, n, v = sum(one.values()), len(one), len(one)
    p = lambda w: float(katz.word_probability(np.array([one[w]]), words_)[0])
    kept = lambda d, c: float(d.discounted(np.array([c]))[0])
    mass, lower = collections.Counter(), collections.Counter()
    for (h, w), c in two.items():
        mass[h] += kept(pairs, c)
        lower[h] += p(w)

    def given(w, h):
        size, weight = (float(x[0]) for x in katz.backoff(*[np.array([float(c[h])]) for c in (follows, mass, lower)]))
        return kept(pairs, two[h, w]) / size if two[h, w] else weight * p(w)

    for h in [*list(follows)[:15], b"unseen"]:
        assert sum(given(w, h) for w in one) + given(b"\tunknown", h) == pytest.approx(1)
    return [
        (
            len(t), sum(one[w] > 0 for w in t), total,
            sum(math.log10((one[w] + 0.5) / (total + 0.5 * (v + 1))) for w in t),
            sum(math.log10(given(w, h)) for h, w in zip([b" begin", *t], t)),
        )
        for t in texts
    ]


@pytest.mark.parametrize("chunk, entries", [(1 << 21, 1 << 20), (300, 200)])
def test_katz(spark, chunk, entries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    training = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    want = dict(zip([i for i, _ in rows], _plain_katz(rows, training)))
    found = katz.score(docs, fold_of(F.col("doc_id"), 5) != 1, chunk=chunk, entries=entries).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.training == training(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[r.doc_id])
    held = [r for r in found if not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_long_texts_cross_chunks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d " * 200), (2, "a b"), (3, None)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in katz.score(docs, F.lit(True)).collect()}
    small = {r.doc_id: r.score for r in katz.score(docs.coalesce(1), F.lit(True), chunk=3, entries=2).collect()}
    assert small == pytest.approx(whole)


def test_katz_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = katz.score(docs, F.lit(False)).collect()
    assert all((r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0) for r in rows)


def test_ctph_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    found = {r.doc_id: r for r in ctph.neighbours(docs).collect()}
    assert len(found) == len(texts)
    for at, (i, text) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r = found[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(text), ctph.fingerprint(edited))
        assert r.near_edited == ctph.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == ctph.likeness(r.fingerprint, ctph.fingerprint(following))


def test_fingerprint_column(spark):
    rows = ctph.with_fingerprint(tables.documents(spark).drop("fingerprint")).collect()
    assert all(r.fingerprint == ctph.fingerprint(r.text) for r in rows)
