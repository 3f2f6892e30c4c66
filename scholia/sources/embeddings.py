"""Embeddings kept by model and item, row i of a document's chunks in row i."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

SCHEMA = "model string, item_key string, row int, vector array<float>"


class EmbeddingCache:
    """A Parquet table partitioned by model and item: a lookup reads one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        try:
            df = self.spark.read.parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)
        return df.select(F.col("model").cast("string"), F.col("item_key").cast("string"), "row", "vector")

    def save(self, rows: DataFrame, size: int, replace: bool = False) -> None:
        """Adds items (SCHEMA); vectors of another size are an error, and so, without ``replace``, are items held already."""
        bad = rows.where((F.size("vector") != size) | F.col("vector").isNull())
        if not bad.isEmpty():
            raise ValueError(f"a vector has not {size} numbers")
        held = self.table().select("model", "item_key").distinct()
        if not replace and not rows.join(held, ["model", "item_key"], "left_semi").isEmpty():
            raise FileExistsError("an item's embeddings are held already")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "item_key").parquet(self.path)

    def load(self, model: str, item_key: str, row: int | None = None) -> DataFrame:
        found = self.table().where((F.col("model") == model) & (F.col("item_key") == item_key))
        return found.orderBy("row") if row is None else found.where(F.col("row") == row)

    def pairs(self) -> DataFrame:
        return self.table().select("model", "item_key").distinct()

    def is_fresh(self, model: str, item_key: str, n_chunks: int) -> bool:
        """Whether as many rows are held as the item has chunks."""
        return self.load(model, item_key).count() == n_chunks
