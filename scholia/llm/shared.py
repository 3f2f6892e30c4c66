"""What the operators share: the shared folder, written tables, word patterns and components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: ASCII white space, as a regex class.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or that set on the context.  Where neither is set, a local session, as in tests, gets a temporary one; a cluster is an error, since its machines would not see each other's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return folder.rstrip("/")


def _where(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends if it is not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _where(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of this module that nothing reads any more."""
    for path in paths:
        files, where = _where(spark, path)
        files.delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``written`` tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def deals(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input that one task of a range partitioning is meant to take.
TASK_BYTES = 32 << 20


def parts_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for ``df``: by the size Spark estimates for it, so a task's share stays the same as the input grows; at least the session's own number."""
    estimated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = deals(df.sparkSession)
    return least if estimated >= 1 << 60 else max(least, -(-estimated // task_bytes))


#: Bytes, as measured, up to which a table is broadcast; beyond it Spark joins by shuffle, with the same result.
MOST_BROADCAST = 48 << 20


def measured(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: eight for a number, a string's own, sixteen for each member of an array and 48 for the row."""
    width = lambda c, kind: F.octet_length(c) if kind == "string" else 16 * F.size(c) if kind.startswith("array") else F.lit(8)
    one = sum((F.coalesce(width(F.col(c), kind), F.lit(0)).cast("long") for c, kind in df.dtypes), F.lit(48).cast("long"))
    return df.agg(F.sum(one)).head()[0] or 0


def sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if measured(df) <= MOST_BROADCAST else df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast: ``pick(docs, doc_id='long', text='string')``.  Further columns, whatever their names, are left out."""
    return df.select(*[df[c].cast(kind).alias(c) for c, kind in columns.items()])


#: A node with more neighbours than this, and than a ten-thousandth of all links, is joined by broadcast; so at most 10,000 are.
HUB = 256


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """u, v, m: each of ``n`` distinct pairs with the least v of its u.

    The rows of a hub would meet in one task of a join by u.  Its least v is one row, and hubs are few by
    their bound, so they are broadcast; the rest is joined by shuffle.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB, n // 10_000)
    hubs = low.where(hub).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = pairs.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    rest = marked.where("hub is null").select("u", "v").join(low.where(~hub).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).union(rest.select("u", "v", "m"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, component) per node, component its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes, which takes a
    number of rounds that grows with the logarithm of the largest component.  A round is two grouped
    minima with partial sums, and joins in which hubs are set apart, so no group is gathered in one task.
    Rounds are written to the shared folder; older ones are deleted.
    """
    spark = edges.sparkSession
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    kept, last = fresh_path(spark, "edges"), None
    pair.write.parquet(kept)
    n = spark.read.schema("u long, v long").parquet(kept).count()
    while True:
        pair = spark.read.schema("u long, v long").parquet(kept)
        both = pair.select("u", "v").union(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", "m")
        large = _with_least(both, 2 * n).where((F.col("v") > F.col("u")) & (F.col("v") != least)).select(F.col("v").alias("u"), least.alias("v")).distinct()
        ends = F.array(F.struct(F.col("u").alias("x"), F.col("m").alias("y")), F.struct(F.col("v").alias("x"), F.col("m").alias("y")))
        small = _with_least(large, n).select(F.explode(ends).alias("e")).where("e.x <> e.y").select(F.col("e.x").alias("u"), F.col("e.y").alias("v")).distinct()
        path = fresh_path(spark, "edges")
        small.write.parquet(path)
        mark = spark.read.schema("u long, v long").parquet(path).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        removed(spark, kept)
        kept, n = path, mark[0]
        if mark == last:
            break
        last = mark
    star = spark.read.schema("u long, v long").parquet(kept)
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
