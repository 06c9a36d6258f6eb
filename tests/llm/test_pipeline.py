"""The pipeline's stages keep what they should, and every operator query has a name of its own."""

import os
import re

import pytest

import corpus_pipeline
from larkspur.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if name == "PII":
            assert set(after) == set(before)
            assert not any(re.search(r"[\w.]+@mail\d\.example\.com", t or "") for t in after.values())
        else:
            assert all(before[i] == t for i, t in after.items())
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.collect()} == set(before)
