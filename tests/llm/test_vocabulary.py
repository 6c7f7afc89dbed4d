"""Packing never takes an estimate for a count."""

import base64

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from noteloom.llm import packing, queries


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "abcdefghi jk")], "doc_id long, text string")


@pytest.mark.parametrize("kind", ["missing", "empty", "blank", "cut", "no bytes", "ranks left out", "other file", "folder", "no name"])
def test_packing_fails_without_a_whole_vocabulary(docs, tmp_path, kind):
    path = tmp_path / "vocabulary"
    whole = b"".join(b"%s %d\n" % (base64.b64encode(bytes([i])), i) for i in range(256))
    made = {"empty": b"", "blank": b"\n\n", "cut": whole[:-4], "no bytes": whole[:-100], "ranks left out": whole + b"YWI= 300\n", "other file": b'{"a": 1}\n'}
    if kind in made:
        path.write_bytes(made[kind])
    elif kind == "folder":
        path.mkdir()
    with pytest.raises((OSError, ValueError)):
        packing.pack(docs, tokenizer="" if kind == "no name" else str(path))


def test_a_whole_vocabulary_counts_and_none_estimates(docs, tmp_path):
    path = tmp_path / "vocabulary"
    path.write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(bytes([i])), i) for i in range(256)))
    assert packing.pack(docs, tokenizer=str(path)).agg(F.sum("n_tokens")).first()[0] == 12
    assert packing.pack(docs, tokenizer=None).agg(F.sum("n_tokens")).first()[0] == 4


def test_the_queries_fail_without_the_vocabulary(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    real = packing.vocabulary
    monkeypatch.setattr(packing, "vocabulary", lambda path: real(f"{tmp_path}/{path}"))
    with pytest.raises(FileNotFoundError):
        queries.QUERIES["op4_packing"](spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        corpus_pipeline.pack(spark, docs, str(tmp_path))


def test_lengths_that_are_estimated_for_want_of_a_file_say_so(docs):
    with pytest.warns(UserWarning, match="estimates"):
        packing.lengths(docs, "/nowhere/at/all")
