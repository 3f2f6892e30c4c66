"""Token counts as rollups that signed deltas maintain, with idempotent batch commits."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder, slices
from .shared import SPACE, pick

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counts(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: each row's whole text counted under each tokenizer version (name: vocabulary file).

    A null text has no tokens; null ids, sources and languages are kept, the latter as groups of their own;
    repeated rows each give a row; a text of any length is counted whole; an empty table gives an empty
    one; other columns, whatever their names, are left out.
    """

    def run(batches):
        for batch in batches:
            for name, path in vocabularies.items():
                counted = [encoder(path).encode(batch.column(3).slice(a, b - a))[1] for a, b in slices(batch.column(3))]
                n = np.concatenate([np.zeros(0, np.int64), *counted])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([name] * len(n), pa.string()), pa.array(n)], names=["doc_id", *KEYS, "n_tokens"])

    return pick(docs, doc_id="long", source="string", lang="string", text="string").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def word_counts(docs: DataFrame, name: str = "words-1") -> DataFrame:
    """As ``counts``, in every case, for a tokenizer version of runs without ASCII white space."""
    rows = pick(docs, doc_id="long", source="string", lang="string", text="string")
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select("doc_id", "source", "lang", F.lit(name).alias("tokenizer"), F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("n_tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    """Deltas that add documents: one of each row; an empty table gives none."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Deltas that take documents back; ``counted`` holds the counts they were added with."""
    return inserts(counted).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas that replace counts: what stood before is taken back, what stands after is added; groups may differ."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals by source, language and tokenizer version at ``path``, and the batches that made them.

    Each commit writes totals plus the batch's summed deltas as a new snapshot, then publishes a manifest
    (the snapshot's number and the batch's name) under the next number in one step that fails if that
    number is taken.  So a batch that was committed is not added again, a lost job leaves nothing behind
    that is read, and of two writers one fails.  Groups whose documents are all gone leave the totals; so
    do snapshots, but for the last few.  Null group keys are groups; deltas of no rows change no total.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.files.listStatus(self._path(folder))] if self.files.exists(self._path(folder)) else []

    def _write(self, name: str, text: str) -> None:
        out = self.files.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _state(self) -> dict:
        """The last manifest; its batch's mark is set again if a lost job left it out."""
        number = max((int(n) for n in self._names("manifests") if n.isdigit()), default=-1)
        if number < 0:
            return {"snapshot": -1, "batch": ""}
        stream = self.files.open(self._path(f"manifests/{number}"))
        try:
            state = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if not self.files.exists(self._path(f"batches/{state['batch']}")):
            self._write(f"batches/{state['batch']}", str(number))
        return state

    def _publish(self, half: str, number: int) -> None:
        """Gives a written manifest its number in one step, which fails if the number is taken: a hard link on a local disk, elsewhere the file system's own rename without overwriting."""
        whole = f"manifests/{number}"
        self.files.mkdirs(self._path("manifests"))
        try:
            if self.files.getUri().getScheme() == "file":
                local = lambda name: self.jvm.java.nio.file.Paths.get(self._path(name).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
                self.jvm.java.nio.file.Files.createLink(local(whole), local(half))
            else:
                how = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                once = self.spark.sparkContext._gateway.new_array(how, 1)
                once[0] = how.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self._path(half), self._path(whole), once)
        except Py4JJavaError as e:
            raise RuntimeError(f"another writer committed snapshot {number}") from e

    def _snapshot(self, state: dict) -> DataFrame:
        if state["snapshot"] < 0:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals-{state['snapshot']}-{state['batch']}")

    def totals(self) -> DataFrame:
        return self._snapshot(self._state())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch's deltas; False if the batch was added before.  The batch's name goes into a path: letters, digits, ``_`` and ``-``."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        state = self._state()
        if self.files.exists(self._path(f"batches/{batch}")):
            return False
        number = state["snapshot"] + 1
        rows = self._snapshot(state).unionByName(deltas.select(*KEYS, "n_docs", "n_tokens"))
        rows = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        rows.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/totals-{number}-{batch}")
        half = f"halves/{number}-{uuid.uuid4().hex}"
        self._write(half, json.dumps({"snapshot": number, "batch": batch}))
        self._publish(half, number)
        self._write(f"batches/{batch}", str(number))
        self.files.delete(self._path(half), True)
        for name in self._names(""):
            if name.startswith("totals-") and int(name.split("-")[1]) <= number - self.KEPT:
                self.files.delete(self._path(name), True)
        return True
