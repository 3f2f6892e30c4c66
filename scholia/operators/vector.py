"""Nearest neighbours and grouped nearest neighbours, exact: filters come before distances, the vector goes right after."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from . import index

#: Hits a grouped search looks at, as multiples of its limit.
WIDE, SECTIONS = 15, 10


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance in double precision, to six decimals."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.round(F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x), 6)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity; a zero vector: 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot(vector, vector) * F.lit(float(sum(x * x for x in query))))
    return F.round(F.when(length > 0, dot(vector, q) / length).otherwise(F.lit(0.0)), 6)


def nearest(df: DataFrame, query: list[float], limit: int, ident: str, vector: str = "vector") -> DataFrame:
    """The ``limit`` rows nearest to ``query`` with their ``score`` (lower is nearer); ties by id.  A null vector is no hit."""
    hits = df.where(F.col(vector).isNotNull()).withColumn("score", squared_distance(F.col(vector), query)).drop(vector)
    return hits.orderBy("score", ident).limit(limit)


def grouped(df: DataFrame, query: list[float], limit: int, keys: list[str], ident: str, wide: int = WIDE, vector: str = "vector", extra: list[Column] | None = None) -> DataFrame:
    """Nearest groups: of the ``limit * wide`` nearest rows, each group's best score, its row's id and text, and its number of hits."""
    hits = nearest(df, query, limit * wide, ident, vector)
    best = F.struct("score", ident)
    found = hits.groupBy(*keys).agg(F.min("score").alias("score"), F.min_by(ident, best).alias("best_id"), F.min_by("text", best).alias("best_text"), F.count("*").alias("hits"), *(extra or []))
    return found.withColumn("preview", preview(F.col("best_text"))).drop("best_text").orderBy("score", *keys).limit(limit)


def search_chunks(chunks: DataFrame, query: list[float], limit: int = 5) -> DataFrame:
    """The nearest chunks with the ids and previews of the chunks before and after each.

    Neighbours are looked up in the sections of the hits alone, of which there are at most ``limit``; so
    few that they may be broadcast.
    """
    hits = nearest(chunks, query, limit, "chunk_id")
    near = index.neighbours(chunks.drop("vector").join(F.broadcast(hits.select(*index.SECTION).distinct()), index.SECTION, "left_semi"))
    near = near.select("chunk_id", "prev_id", "next_id", "prev_preview", "next_preview")
    return hits.join(near, "chunk_id").orderBy("score", "chunk_id")


#: Hits of a search by meaning, and characters of a query from which it is sent as a body.
LEAST_FOUND, MOST_FOUND, LONG_QUERY = 1, 100, 2048


def found_by_meaning(df: DataFrame, query: list[float], count: int, ident: str, vector: str = "vector") -> DataFrame:
    """The ``count`` rows most similar to the query, 1 to 100, with their ``score`` (higher is nearer)."""
    if not LEAST_FOUND <= count <= MOST_FOUND:
        raise ValueError("a search by meaning finds 1 to 100 rows")
    return df.withColumn("score", cosine(F.col(vector), query)).drop(vector).orderBy(F.desc("score"), ident).limit(count)


def sent_as(query: Column) -> Column:
    """How a query's text is sent: long ones as a body."""
    return F.when(F.length(query) > LONG_QUERY, "POST").otherwise("GET")


def search_works(df, query, limit=5, ident="chunk_id"):
    return grouped(df, query, limit, ["paper_id"], ident)


def search_chapters(df, query, limit=5, ident="chunk_id"):
    return grouped(df, query, limit, ["paper_id", "chapter_idx"], ident, extra=[F.countDistinct("section_idx").alias("sections")])


def search_sections(df, query, limit=5, ident="chunk_id"):
    return grouped(df, query, limit, ["paper_id", "chapter_idx", "section_idx"], ident, wide=SECTIONS)


def embedding_text(title: Column, chapter: Column, section: Column, text: Column) -> Column:
    """Title, chapter and section joined by dashes over the text; a section stands only below a chapter."""
    blank = lambda c: F.nullif(c, F.lit(""))
    head = F.concat_ws(" — ", blank(title), blank(chapter), F.when(blank(chapter).isNotNull(), blank(section)))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def exhibit_text(kind: Column, caption: Column, description: Column, content: Column) -> Column:
    """Caption, description and, of an algorithm, content, by line."""
    return F.concat_ws("\n", F.nullif(caption, F.lit("")), F.nullif(description, F.lit("")), F.when(kind == "algorithm", F.nullif(content, F.lit(""))))


def hashing_embedder(size: int = 64):
    """A deterministic embedder for tests and as the default: hashed words, unit length; a batch's vectors are one array, whatever the input."""

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        known: dict[str, tuple[int, int]] = {}
        vectors = np.zeros((len(texts), size), np.float32)
        for v, text in zip(vectors, texts):
            for w in (text.as_py() or "").lower().split():
                if w not in known:
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    known[w] = h % size, 1 if h >> 63 else -1
                at, sign = known[w]
                v[at] += sign
        length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        vectors /= np.where(length > 0, length, 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(vectors.ravel()))

    return embed
