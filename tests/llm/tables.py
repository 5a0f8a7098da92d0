"""Small tables with everything that is awkward, and empty ones."""

from __future__ import annotations

import duckdb
import pandas as pd

LONG = "Lorem ipsum dolor sit amet " * 8000

_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, fingerprint string, slice string, size string"
_EXTRA = ("x", "y", "z", "0")


def documents(spark, empty: bool = False):
    texts = [
        (0, "the cat sat on the mat and looked at the dog", "en", "a"),
        (1, "le chat noir est sur la table de la maison", "fr", "b"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n", "fr", "b"),
        (5, LONG, "en", "a"),
        (6, "the cat sat on the mat and looked at the dog", "en", None),
        (7, "12345 !!!", None, ""),
        (7, "12345 !!!", None, ""),
        (8, "x" * 3000, "en", "c"),
        (9, "la maison est belle et la table est dans la cuisine", "fr", "b"),
        (9, "another text under the same number", "en", "b"),
        (None, "no number here", "en", "a"),
        (-5, "de la lune au soleil É", "fr", "é"),
    ]
    rows = [(i, t, lang, source, None if t is None else len(t), *_EXTRA) for i, t, lang, source in texts]
    return spark.createDataFrame([] if empty else rows, _DOCUMENTS)


def labels(spark, empty: bool = False):
    rows = [(0, 1, 0), (1, 1, None), (2, 0, 0), (3, None, 0), (7, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 0)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, quality int, toxic int")


def pages(spark, empty: bool = False):
    rows = [
        (1, "http://a", "<p>same</p>", "q"), (2, "http://b", "<p>same</p>", "q"), (3, None, "<p>é</p>", None), (4, "u", None, "q"),
        (5, "u", "", "q"), (6, "u", LONG, "q"), (7, "u", LONG, "q"), (8, "u", "<p>same</p>", "q"), (9, "u", "<p>other</p>", "q"),
    ]
    return spark.createDataFrame([] if empty else rows, "page_id long, url string, html string, refers_to string")


def conversations(spark, empty: bool = False):
    rows = [
        (1, 1, "assistant", "second", 1), (1, 0, "user", "first", 1), (1, 2, "assistant", "third <|im_end|>\n</s>", 1),
        (2, 0, "user", None, 1), (2, None, "system", "no turn", 1), (3, 0, "assistant", "", 1), (3, 0, "assistant", "tie", 1),
        (3, 0, "assistant", "tie", 1), (4, 0, None, "no role", 1), (5, 0, None, None, 1), (6, 0, "assistant", LONG, 1), (None, 0, "user", "x", 1),
    ]
    return spark.createDataFrame([] if empty else rows, "conv_id long, turn long, role string, text string, place int")


def embeddings(spark, empty: bool = False):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], 0) for i in range(1, 120)]
    rows += [
        (0, [1.0, 2.0, 3.0], 0), (150, [1.0, 2.0, 3.0], 0), (200, None, 0), (201, [0.0, 0.0, 0.0], 0), (250, [float("nan"), 1.0, 1.0], 0),
        (251, [1.0, None, 1.0], 0), (252, [float("inf"), 0.0, 0.0], 0), (253, [1.0, 2.0], 0), (300, [2.0, 4.0, 6.0], 0), (None, [1.0, 1.0, 1.0], 0),
        (50, [1.0, 1.0, 2.0], 0),
    ]
    return spark.createDataFrame([] if empty else rows, "vec_id long, embedding array<float>, label int")


TABLES = {"documents": documents, "labels": labels, "pages": pages, "conversations": conversations, "embeddings": embeddings}


def written(spark, folder, empty: bool = False) -> str:
    for name, made in TABLES.items():
        made(spark, empty).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sql(folder: str, query: str) -> pd.DataFrame:
    connection = duckdb.connect()
    import os

    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            connection.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection.sql(query).df()
