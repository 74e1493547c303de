"""Small tables for the training-data operators: the smallest driver tables and one of edge cases."""
import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

EDGE_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp long, key binary, score double, label string, "
               "spans string, text_hash long, n long, row int, p string, copies int, domain string, r string, word string")
LONG = " ".join(f"word{i % 977} tail{i % 31}." for i in range(9000))
EDGE = [(1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, None), (4, "one", "de", "s"),
        (5, "The same text stands here twice, word for word, and it is long enough to be cut into shingles and grams of all sizes.", "en", "s"),
        (6, "The same text stands here twice, word for word, and it is long enough to be cut into shingles and grams of all sizes.", "en", "s"),
        (7, LONG, "fr", "t"), (8, "\x00 nul and \x1c control é ß 日本 \U0001f600 signs", "es", "t"),
        (9, "Released under the MIT License.\nYou idiot. GNU General Public License, version 3.", "en", "t"),
        (9, "Released under the MIT License.\nYou idiot. GNU General Public License, version 3.", "en", "t"),
        (None, "no id at all", "en", "s")]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, copies, a repeated row, a null id, and clashing column names."""
    rows = [(i, t, lang, s, len(t) if t else None) + (1, b"x", 0.5, "x", "x", 1, 1, 1, "x", 1, "x", "x", "x") for i, t, lang, s in EDGE]
    return spark.createDataFrame(rows, EDGE_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_labels(spark):
    return spark.createDataFrame([(5, 1, 0), (4, 0, 0), (9, 0, 1), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
