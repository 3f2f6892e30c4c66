"""The document index on disk: two tables partitioned by paper, upserts, removals, batch ingestion."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

TABLES = {"chunks": schemas.CHUNKS, "exhibits": schemas.EXHIBITS}


def default_path(given: str | None = None) -> str:
    """The path given, else of the environment, else below the user's data folder."""
    return given or os.environ.get("SCHOLIA_INDEX") or os.path.join(os.environ.get("SCHOLIA_HOME") or os.path.expanduser("~/.local/share/scholia"), "index")


#: Folders of a table: articles are dealt to them by a hash of their ids.
BUCKETS = 256


class Store:
    """Chunks and exhibits as Parquet, dealt to ``buckets`` folders by a hash of ``paper_id``, so folders and files stay few however many articles there are.

    With ``buckets`` 0 every article has a folder of its own, which suits small collections: filters on ``paper_id`` then prune folders.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _place(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or where it does not stand yet an empty one with its schema; ``buckets``: of these folders only.  A table that cannot be read is an error."""
        files, path = self._place(name)
        if not files.exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        order = [f.name for f in TABLES[name].fields]
        kept = df.drop("bucket") if "bucket" in df.columns else df.withColumn("paper_id", F.col("paper_id").cast("string"))
        return schemas.migrated(kept, name, schemas.VERSION - 1 if set(order) - set(kept.columns) else schemas.VERSION).select(order)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Articles in ``rows`` replace what the table holds of them; others stay.

        Buckets: the folders touched, whose numbers come to the driver, are read and rewritten from what stays
        and ``rows``, by way of a staged copy, since they are read and written at once.  One folder an
        article: folders are swapped by dynamic overwrite.
        """
        if not self.buckets:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").parquet(f"{self.path}/{name}")
            return
        bucket = F.pmod(F.xxhash64("paper_id"), F.lit(self.buckets))
        rows = rows.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        kept = self.table(name, touched).join(rows.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("bucket", bucket)
        self._rewrite(name, kept.select(rows.columns).unionByName(rows))

    def _rewrite(self, name: str, rows: DataFrame) -> set[int]:
        """Overwrites the buckets of ``rows``, which may be read from them: they are written beside the tables first.  Returns these buckets."""
        folder = f"_staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        staged = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")
        staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        written = {r["bucket"] for r in staged.select("bucket").distinct().collect()}
        self._drop(folder)
        return written

    def remove(self, articles: list[str]) -> None:
        """Drops articles from both tables."""
        for name in TABLES:
            if not self.buckets:
                escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
                for paper in articles:
                    self._drop(f"{name}/paper_id={escape(paper)}")
                continue
            bucket = F.pmod(F.xxhash64("paper_id"), F.lit(self.buckets))
            ids = self.spark.createDataFrame([(a,) for a in articles], "paper_id string")
            touched = {r["bucket"] for r in ids.select(bucket.alias("bucket")).distinct().collect()}
            held = self.table(name, list(touched)).withColumn("bucket", bucket)
            touched &= {r["bucket"] for r in held.select("bucket").distinct().collect()}
            written = self._rewrite(name, held.join(ids, "paper_id", "left_anti"))
            # A bucket left empty has no rows to overwrite it with.
            for b in touched - written:
                self._drop(f"{name}/bucket={b}")

    def _drop(self, folder: str) -> None:
        files, path = self._place(folder)
        files.delete(path, True)

    def to_ingest(self, candidates: DataFrame, force: bool = False) -> DataFrame:
        """Candidates (paper_id) that the index lacks; ``force``: all."""
        return candidates if force else candidates.join(self.table("chunks").select("paper_id").distinct(), "paper_id", "left_anti")


def outcome_counts(candidates: DataFrame, indexed: DataFrame, failed: DataFrame) -> DataFrame:
    """status, articles: skipped, failed or ingested of a batch."""
    rows = candidates.join(indexed.select("paper_id").distinct().withColumn("held", F.lit(True)), "paper_id", "left").join(failed.select("paper_id").distinct().withColumn("bad", F.lit(True)), "paper_id", "left")
    return rows.groupBy(F.when(F.col("held"), "skipped").when(F.col("bad"), "failed").otherwise("ingested").alias("status")).agg(F.count("*").alias("articles"))
