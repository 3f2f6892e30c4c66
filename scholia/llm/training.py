"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pick


#: Bytes of text that a model is fitted on at most: rows beyond, in the sample's order, are left out whole, so one task's memory is bounded.
MOST_BYTES = 256 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """text, label (0 or 1) of at most ``most_rows`` documents outside the held-out fold, chosen and ordered by a hash of id and text.

    Conflicting labels of one id count by their largest; null ids and labels are left out.
    """
    known = pick(labels, doc_id="long", **{label: "int"}).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = pick(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id")
    return rows.withColumn("at", F.xxhash64("doc_id", "text")).orderBy("at").limit(most_rows).select("text", "label")


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], list[tuple[str, float]]], most_bytes: int = MOST_BYTES) -> list[tuple[str, float]]:
    """Runs ``fit`` over the whole bounded sample in one task; its named numbers, a model of bounded size, come to the driver.

    The sample is bounded in rows and in bytes; its first row is always read, and every row read is read whole.
    """

    def run(batches):
        texts, labels, held = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                size = text.as_buffer().size if text.is_valid else 0
                if not texts or held + size <= most_bytes:
                    held += size
                    texts.append(text.as_py() or "")
                    labels.append(label.as_py())
        names, values = zip(*fit(texts, np.array(labels, np.float64))) if texts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["name", "value"])

    return [(r.name, r.value) for r in sample.coalesce(1).mapInArrow(run, "name string, value double").collect()]


class Ftrl:
    """Logistic regression by follow-the-regularised-leader updates (McMahan et al., 2013), one row at a time."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-4):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """``at``: distinct places of the row's values ``x``."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
