"""From raw documents to token digests, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet before the next one reads it. All stages but the last return the columns of
``documents`` and their decisions take effect: rejected documents are gone, and the mix
holds a document as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from llm import bpe, language, mixing, quality, queries as llm_queries, simhash
from llm.common import fold_of, table
from stockloom.sources.scratch import keep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in.

    Texts that are null or have no letter go. The score decides nothing: it is no probability,
    and low for short texts. Repeated rows and null ids are rows like any other; an empty table
    stays empty, and extra columns stay.
    """
    folds, left_out = llm_queries.LANGUAGE_FOLD
    model = language.train(docs.where(fold_of(F.col("doc_id"), folds) != left_out))
    found = language.language_of(docs, model)
    return docs.where(found["lang_pred"] != language.UNDETERMINED)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts have a score like any other. Repeated rows and ids stay or go
    together; an empty table stays empty, and extra columns stay.
    """
    folds, left_out = llm_queries.QUALITY_FOLD
    labels = table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id"), folds) != left_out)
    model = quality.train(docs, labels)
    return docs.where(quality.quality_of(docs, model) >= llm_queries.GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Groups are those of ``op1_simhash``: fingerprints of three-word shingles, linked at
    three or fewer differing bits. Rows are told apart by a number of their own, so ids may
    repeat or be null. A row without an id stays only if its group has none; equal ids go by
    a hash of the text. Null and empty texts are a group; extra columns stay, whatever their names.
    """
    # The rows are written with their numbers first, so that these stay the same.
    numbered = keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    doc_id, text = F.col("doc.doc_id"), F.col("doc.text")
    name = F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"), "row")
    groups = simhash.near_duplicates(numbered.select(name.alias("name"), text.alias("text")), "name")
    kept = keep(groups.where("name.row = component_id.row").select("name.row"), "kept_rows")
    # Merged whatever the size: the rows grow with the documents.
    return numbered.join(kept.hint("merge"), "row", "left_semi").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words and null sources: see ``mixing.copies``; repeated and null ids: see
    ``mixing.mixed``. An empty table stays empty, and extra columns stay.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of each document.

    Null texts are empty. Every row has its result, repeated and null ids too; an empty
    table gives an empty one, and other columns are not read.
    """
    return bpe.digests(docs, *llm_queries.vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("byte_bpe", encode),
]

#: The fitted models and the hashes of shingles are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
