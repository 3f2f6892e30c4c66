"""Named selections on disk: one folder each, one of them active."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import checked_name

ENTRIES = "entry long, item_key string, entity_id string, doi string, title string, authors array<string>, year int, issn array<string>, isbn array<string>, work_type string"


class Selections:
    """Each selection is a Parquet folder that is written beside and renamed into place, so a reader never meets half of one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.files.exists(self._at("")):
            return []
        found = (s.getPath().getName() for s in self.files.listStatus(self._at("")) if s.isDirectory())
        return sorted(n for n in found if not n.startswith((".", "_")))

    def resolve(self, asked: str) -> str:
        """A name by its 1-based place among the sorted ones, or by itself, whatever the case."""
        names = self.names()
        if asked.isdigit() and 1 <= int(asked) <= len(names):
            return names[int(asked) - 1]
        for n in names:
            if n.lower() == asked.lower():
                return n
        raise KeyError(f"no selection {asked!r}; there are {', '.join(names) or 'none'}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/{self.resolve(name)}")

    def create(self, name: str, entries: DataFrame | None = None) -> None:
        if checked_name(name) in self.names():
            raise FileExistsError(name)
        self.write(name, self.spark.createDataFrame([], ENTRIES) if entries is None else entries)

    def write(self, name: str, entries: DataFrame) -> None:
        fresh = f".new-{checked_name(name)}"
        held = {c for c in entries.columns}
        full = entries.select(*[(F.col(f.name) if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], ENTRIES).schema.fields])
        full.write.mode("overwrite").parquet(f"{self.path}/{fresh}")
        self.files.delete(self._at(name), True)
        self.files.rename(self._at(fresh), self._at(name))

    def rename(self, old: str, new: str) -> None:
        old = self.resolve(old)
        if checked_name(new) in self.names():
            raise FileExistsError(new)
        active = self.active()
        self.files.rename(self._at(old), self._at(new))
        if active == old:
            self.activate(new)

    def delete(self, name: str) -> None:
        name = self.resolve(name)
        self.files.delete(self._at(name), True)
        if self.active() == name:
            self.activate(None)

    def activate(self, name: str | None) -> None:
        out = self.files.create(self._at("_active"), True)
        out.write(bytearray(json.dumps({"active": name and self.resolve(name)}).encode()))
        out.close()

    def active(self) -> str | None:
        if not self.files.exists(self._at("_active")):
            return None
        stream = self.files.open(self._at("_active"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["active"]
        finally:
            stream.close()
