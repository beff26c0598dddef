from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the table's other columns and clashing ones."""
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("len", T.IntegerType())])

    def make(rows, lang=lambda k: "en"):
        return spark.createDataFrame([(k, t, lang(k), "s", len(t or ""), "clash", 1) for k, t in rows], kinds)

    return make


ODD = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (6, "word " * 3000), (7, "same text here"), (8, "same text here"), (8, "same text here"), (None, "no id"), (9, "Ünïcödé — “x” 日本語 \U0001f600"), (10, "\x00nul\x00"), (11, "x" * 5000)]


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeats, a null id, long and odd characters."""
    return list(ODD)
