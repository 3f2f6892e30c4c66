"""Token ids as ORC files: integer run-length encoded, with row indexes and Bloom filters on the document id."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, slices, with_end
from .shared import parts_for, pick

#: ORC keeps integers of one document in run-length encoding version 2; the row index has min and max
#: of each ``stride`` rows and a Bloom filter of their ids, so a lookup skips stripes and row groups.
ORC = {"compression": "zstd", "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
COLUMNS = "doc_id long, part int, part_start long, n_tokens int, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Writes the ids of every whole ``text`` of ``docs``, ``end_id`` after each, in ascending ``doc_id`` order; returns the table as read back.

    A null text counts as an empty one (its ids are ``end_id`` alone); a null id comes first; rows with
    the same id stand side by side, ordered by a hash of their text, and each is written; an empty table
    gives an empty table; further columns are not written.  Rows are dealt by range of id, text hash
    and place, so many rows with one id, or many equal rows, do not meet in one task, and
    their number follows the input's size.  A text of any length is one row, whose ids must fit a task's memory.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id="long", text="string").withColumns({"tie": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(partitions or parts_for(rows), "doc_id", "tie", "nth").sortWithinPartitions("doc_id", "tie", "nth").select("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary).encode
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, n = with_end(*encode(batch.column(1).slice(a, b - a)), end_id)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                    names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )

    rows.mapInArrow(encode, COLUMNS).write.options(**ORC).orc(path)
    return read_tokens(spark, path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The table at ``path``; with ``ids``, only those documents: stripes and row groups without them are skipped by their indexes."""
    df = spark.read.schema(COLUMNS).orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin(list(ids)))


def token_positions(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document of a table of ``write_tokens``, the sum taken over the ids it holds.

    Totals are one number a written part; they alone go to the driver.
    """
    totals = sorted((r["part"], r["n"]) for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = tokens.sparkSession.createDataFrame(bases, "part int, base long")

    def sums(batches):
        for batch in batches:
            lists = batch.column(3)
            raw, offsets = memoryview(lists.values.buffers()[1]).cast("B"), (np.asarray(lists.offsets) + lists.values.offset).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            n = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n), pa.array(np.array(crc, np.int64))], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    found = tokens.select("doc_id", "part", "part_start", "tokens").mapInArrow(sums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
