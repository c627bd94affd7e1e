from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """A documents table of the given texts, with ids from 0."""

    def make(*texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in zip(ids, texts)], DOCUMENTS)

    return make


@pytest.fixture
def clashing():
    """Adds columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["d", "h", "fp", "score", "component_id", "shard", "row", "size", "list", "v", "c", "label", "group", "rank", "__kept", "a.b"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names if n not in df.columns})
