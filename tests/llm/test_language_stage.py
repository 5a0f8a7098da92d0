"""What the pipeline's first stage keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from llm import language


def test_short_texts_with_a_low_score_stay(spark, monkeypatch):
    rows = [(1, "ja", "de"), (2, "the cat", "en"), (3, "12 !", None), (4, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = F.when(F.coalesce("text", F.lit("")).rlike("[a-z]"), F.struct(F.col("lang").alias("lang_pred"), F.lit(0.2).alias("score")))
    found = F.coalesce(found, F.struct(F.lit(language.UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")))
    monkeypatch.setattr(language, "train", lambda docs: None)
    monkeypatch.setattr(language, "language_of", lambda docs, model: found)
    assert sorted(r.doc_id for r in pipeline.identify_language(spark, docs, "").collect()) == [1, 2]
