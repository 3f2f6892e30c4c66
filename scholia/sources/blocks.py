"""Extraction output as rows: block-tree JSON, reflow trees, page ranges, embedding files, cached responses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<block_type:string,id:string,page:int,html:string,section_hierarchy:map<string,string>>"
PAGES = f"children array<struct<block_type:string,children:array<{BLOCK}>>>"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_path, page_no, block_no and each block's fields of block-tree JSON files, one document a file."""
    docs = spark.read.schema(PAGES).option("multiLine", True).json(path).withColumn("doc_path", F.input_file_name())
    pages = docs.select("doc_path", F.posexplode("children").alias("page_no", "p"))
    return pages.select("doc_path", "page_no", F.posexplode("p.children").alias("block_no", "b")).select("doc_path", "page_no", "block_no", "b.*")


def flattened(text: str) -> list[tuple[int, int | None, str, int | None, str | None, str]]:
    """(seq, parent, type, depth, text, payload) of a reflow document's nodes in page order; the payload holds a node's other fields as JSON."""
    out: list[tuple] = []

    def walk(node: dict, parent: int | None) -> None:
        seq = len(out)
        rest = {k: v for k, v in node.items() if k not in ("type", "children", "depth", "text", "content")}
        out.append((seq, parent, node.get("type", "document"), node.get("depth"), node.get("text", node.get("content")), json.dumps(rest, sort_keys=True, ensure_ascii=False)))
        for child in node.get("children") or []:
            walk(child, seq)

    walk(json.loads(text), None)
    return out


def read_reflow(spark: SparkSession, path: str) -> DataFrame:
    """doc_path and the rows of ``flattened`` of reflow JSON files; the schema is recursive, so a file is one string until it is flat."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_path"), "value")

    def flat(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, *r) for d, v in zip(pdf.doc_path, pdf.value) for r in flattened(v)]
            yield pd.DataFrame(rows, columns=["doc_path", "seq", "parent_seq", "type", "depth", "text", "payload"])

    return docs.mapInPandas(flat, "doc_path string, seq int, parent_seq int, type string, depth int, text string, payload string")


def preferred(reflow: DataFrame, blocks: DataFrame) -> DataFrame:
    """item_key, kind: of a key with both kinds of extraction, the reflow."""
    both = reflow.select("item_key", F.lit("reflow").alias("kind")).unionByName(blocks.select("item_key", F.lit("blocks").alias("kind")))
    return both.groupBy("item_key").agg(F.max("kind").alias("kind"))


def page_range(spec: str) -> list[int]:
    """``1-50,33`` as sorted distinct pages, from 1."""
    pages: set[int] = set()
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        a = int(low)
        b = int(high) if dash else a
        if a < 1 or b < a:
            raise ValueError(f"not a page range: {part!r}")
        pages.update(range(a, b + 1))
    return sorted(pages)


def page_range_column(spec: Column) -> Column:
    """As ``page_range``, over a column; null where the text is not a range."""
    parts = F.transform(F.split(spec, ","), lambda p: F.split(F.trim(p), "-"))
    ends = F.transform(parts, lambda p: F.struct(F.get(p, 0).try_cast("int").alias("a"), F.coalesce(F.get(p, 1), F.get(p, 0)).try_cast("int").alias("b")))
    good = F.forall(ends, lambda e: F.coalesce((e["a"] >= 1) & (e["b"] >= e["a"]), F.lit(False)))
    return F.when(good, F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e["a"], F.greatest(e["a"], e["b"])))))))


def identity(doi: Column, item_key: Column) -> Column:
    """A paper's id: its DOI, or its item key without one."""
    return F.coalesce(F.nullif(doi, F.lit("")), item_key)


def fresh(cache: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Cached rows (ts in epoch seconds) no older than ``ttl_s``."""
    return cache.where(now - F.col("ts") <= ttl_s)
