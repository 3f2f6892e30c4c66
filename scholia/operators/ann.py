"""Approximate search over k-means buckets: off by default, exact within the buckets it probes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector import nearest, squared_distance

#: Rows that the centres are fitted on at most, and rows below which an index is not worth its while.
FITTED_ROWS, LEAST_ROWS = 100_000, 256


def centres(df: DataFrame, buckets: int, vector: str = "vector", ident: str = "chunk_id", seed: int = 1) -> np.ndarray | None:
    """Bucket centres fitted on a bounded sample, chosen by a hash of the id; None for few rows."""
    sample = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident)).limit(FITTED_ROWS).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if sample.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    return np.array(KMeans(k=buckets, seed=seed, maxIter=15).fit(sample).clusterCenters())


def bucketed(df: DataFrame, at: np.ndarray, vector: str = "vector") -> DataFrame:
    """Every row with the number of its nearest centre; write it partitioned by ``bucket``."""
    far = F.array(*[squared_distance(F.col(vector), c.tolist()) for c in at])
    return df.withColumn("far", far).withColumn("bucket", (F.array_position("far", F.array_min("far")) - 1).cast("int")).drop("far")


def probe(df: DataFrame, at: np.ndarray, query: list[float], limit: int, ident: str, probes: int = 4, vector: str = "vector") -> DataFrame:
    """The nearest rows among the buckets whose centres are nearest to the query: other folders are pruned."""
    order = np.argsort(((at - np.array(query)) ** 2).sum(1))[:probes]
    return nearest(df.where(F.col("bucket").isin([int(k) for k in order])), query, limit, ident, vector)
