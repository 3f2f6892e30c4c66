"""Quality scores: hashed word n-grams, logistic regression by FTRL, sparse dot products."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import slices
from .shared import pick
from .training import Ftrl, fitted, held_out, labelled_sample, logistic

#: Buckets of the hash, labelled documents learnt from at most, passes over them, scale of frequencies.
BUCKETS, MOST_ROWS, PASSES, SCALE = 1 << 18, 8000, 3, 16.0
#: Word features a worker holds before it starts anew.
CACHED_WORDS = 400_000
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: ("A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a")), (re.compile(r"\d+"), lambda m: "0")]


class Grams:
    """Places of the hashed 1- and 2-grams of whole texts: of the words, of their shapes (case, digits, marks), and repeats.

    A value is the gram's frequency among its kind in the text times SCALE, so the length of a text
    does not move its score and a score is a mean of weights over the text's grams.
    """

    KINDS = 5

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.words, self.shapes = [], []

    def _learn(self, word: bytes) -> int:
        text = word.decode(errors="replace")
        shape = text
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        self.words.append(zlib.crc32(text.lower().encode(errors="replace")))
        self.shapes.append(zlib.crc32(shape.encode(errors="replace")))
        self.known[word] = len(self.words) - 1
        return len(self.words) - 1

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each kind of gram: places (in 0 .. BUCKETS) of all texts one after the other, and how many each text has."""
        if len(self.known) > CACHED_WORDS:
            self.__init__()
        split = [t.encode(errors="replace").split() for t in texts]
        get, learn = self.known.get, self._learn
        codes = np.array([k if (k := get(w)) is not None else learn(w) for ws in split for w in ws], np.int64)
        n = np.array([len(ws) for ws in split], np.int64)
        word, shape = np.array(self.words, np.uint64)[codes], np.array(self.shapes, np.uint64)[codes]
        last = np.zeros(len(codes), bool)
        last[(np.cumsum(n) - 1)[n > 0]] = True
        pair = ~last[:-1]
        mix = lambda a, b, salt: ((a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(46)
        zero = np.uint64(0)
        grams = [
            (mix(word, zero, 1), n),
            (mix(shape, zero, 2), n),
            (mix(word[:-1], word[1:], 3)[pair], np.maximum(n - 1, 0)),
            (mix(shape[:-1], shape[1:], 4)[pair], np.maximum(n - 1, 0)),
            (mix((word[:-1] == word[1:]).astype(np.uint64), zero, 5)[pair], np.maximum(n - 1, 0)),
        ]
        return [g.astype(np.int64) for g, _ in grams], [k for _, k in grams]

    def rows(self, texts: list[str]):
        """Sparse rows (distinct places, values) of texts; the last place is the constant."""
        grams, counts = self.of(texts)
        ends = [np.cumsum(k) for k in counts]
        for i in range(len(texts)):
            at = [g[e[i] - k[i] : e[i]] for g, e, k in zip(grams, ends, counts)]
            value = np.concatenate([np.full(len(a), SCALE / max(1, len(a))) for a in at])
            places, back = np.unique(np.concatenate(at), return_inverse=True)
            yield np.append(places, BUCKETS), np.append(np.bincount(back, value, len(places)), 1.0)

    def scores(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        grams, counts = self.of(texts)
        total = np.full(len(texts), weights[BUCKETS], np.float64)
        for g, k in zip(grams, counts):
            has = k > 0
            if has.any():
                total[has] += SCALE * np.add.reduceat(weights[g].astype(np.float64), (np.cumsum(k) - k)[has]) / k[has]
        return logistic(total)

    def of_column(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        """Scores of a column of texts, a slice of about a megabyte at a time."""
        return np.concatenate([np.zeros(0), *(self.scores([t or "" for t in texts.slice(a, b - a).to_pylist()], weights) for a, b in slices(texts, 1_500_000))])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> np.ndarray:
    """Weights (float32, BUCKETS + 1 of them whatever the input) learnt from a bounded sample of labelled rows."""

    def fit(texts, y):
        model, grams = Ftrl(BUCKETS + 1), Grams()
        rows = [(at.astype(np.int32), x.astype(np.float32)) for a in range(0, len(texts), 200) for at, x in grams.rows(texts[a : a + 200])]
        for _ in range(PASSES):
            for (at, x), target in zip(rows, y):
                model.learn(at, x, target)
        w = model.weights()
        return [(str(k), float(w[k])) for k in np.flatnonzero(w)]

    weights = np.zeros(BUCKETS + 1, np.float32)
    for k, w in fitted(labelled_sample(docs, labels, label, most_rows), fit):
        weights[int(k)] = w
    return weights


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    A null or blank text has the constant's score; null ids and repeated rows are scored like any
    other, equal texts equally; a text of any length is read whole, its score a mean over its grams;
    without labels every score is 0.5; a score equal to the threshold predicts 1; an empty table gives an
    empty one; other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        grams = Grams()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams.of_column(batch.column(1), held.value))], names=["doc_id", "score"])

    found = pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``.

    Each row is judged by its own whole text, cast to a string; a null or blank text has the constant's
    score; null ids, repeated rows and ties at the threshold stay; long texts are read in slices of rows;
    an empty table gives an empty one; columns of any name and type pass through.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index("text")

    def run(batches):
        grams = Grams()
        for batch in batches:
            yield batch.filter(pa.array(grams.of_column(batch.column(at).cast(pa.string()), held.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
