"""Functions that work within a row or a batch: no shuffle, and the same results as plain loops."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import vector


@pytest.mark.parametrize("most", [3, text.MOST_WORDS])
def test_inverted_index(spark, monkeypatch, most):
    """Places of words of each row alone, of repeated and null ids too, without a shuffle."""
    monkeypatch.setattr(text, "MOST_WORDS", most)
    texts = [" b a\tb ", "a", None, "", "c c c é", "b a " * 500]
    rows = spark.createDataFrame([(None if k == 4 else 1, k, t) for k, t in enumerate(texts)], "doc_id int, k int, text string").coalesce(1)
    index = rows.select("k", "text", text.inverted_index(text.words(F.col("text"))).alias("m")).where("k >= 0")
    held = index.withColumn("again", text.inverted_index_text(F.col("m")))
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()
    for r in held.collect():
        words = None if r.text is None else r.text.split()
        assert r.m == (None if words is None else {w: [k for k, x in enumerate(words) if x == w] for w in words})
        assert r.again == (None if words is None else " ".join(words))


def test_embedder(spark):
    """Equal to one text after the other; the vectors of a batch are made as one array, so no list stands for a row."""
    texts = ["a B a", None, "", "some words of a text", "a b a"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").coalesce(1)
    plan = rows.select("k", vector.hashing_embedder(16)(F.col("text")).alias("v"))
    for r in plan.collect():
        want = np.zeros(16, np.float32)
        for w in (texts[r.k] or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            want[h % 16] += 1 if h >> 63 else -1
        n = float(np.sqrt((want * want).sum()))
        assert r.v == (want / n if n else want).tolist()
    batch = vector.hashing_embedder(16).func(pa.array(["x"] * 3))
    assert isinstance(batch, pa.ListArray) and batch.type == pa.list_(pa.float32())
