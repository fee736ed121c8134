import os

import pandas as pd

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", None, 4),
    (4, "one", "en", "a", 3),
    (5, "the same words in every copy of this text", "en", "b", 41),
    (6, "the same words in every copy of this text", "en", "b", 41),
    (6, "the same words in every copy of this text", "en", "b", 41),
    (None, "the same words in every copy of this text", "en", "b", 41),
    (None, "a text without an id and without a twin", None, "b", 40),
    (7, "é" * 30 + " ü😀 日本語 " + "x" * 30, "de", "", 75),
    (8, "long words " * 40_000, "en", "c", 440_000),
    (9, "1234 5678 !!! ??? 90", "en", "c", 20),
    (10, "\x00 null bytes \x00 and   separators  ", "fr", "a", 40),
]


def edges(spark, clash=True):
    df = spark.createDataFrame(EDGES, SCHEMA)
    if clash:  # names that the operators use inside
        for name in ("fp", "t", "th", "k", "v", "digest", "key", "block", "row", "size", "kept", "part", "copy", "which", "term", "__id", "count"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def table(df) -> pd.DataFrame:
    return df.toPandas()
