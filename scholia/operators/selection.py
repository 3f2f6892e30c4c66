"""Named selections of articles: set operations by several keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_doi

KEYS = ["item_key", "entity_id", "bare"]
_NAME = re.compile(r"[\w-]+", re.U)


def checked_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a selection's name: {name!r}")
    return name


def with_keys(entries: DataFrame) -> DataFrame:
    return entries.withColumn("bare", bare_doi(F.col("doi")))


def absent(entries: DataFrame, target: DataFrame) -> DataFrame:
    """Entries that share no key with ``target``: one anti-join a key, and null keys never match."""
    rows, target = with_keys(entries), with_keys(target)
    for key in KEYS:
        rows = rows.join(target.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return rows.select(entries.columns)


def first_of_each(entries: DataFrame, order: str) -> DataFrame:
    """Entries of which no earlier one, by ``order``, has the same value of any key.

    Each key's first entry is a grouped minimum; entries without the key are not shuffled by it, as they
    would all meet in one task.
    """
    rows = with_keys(entries)
    for key in KEYS:
        first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
        held = rows.where(F.col(key).isNotNull()).join(first, key).withColumn(f"n_{key}", F.col(order) == F.col("first"))
        rows = held.select(*rows.columns, f"n_{key}").unionByName(rows.where(F.col(key).isNull()).withColumn(f"n_{key}", F.lit(True)))
    return rows.where(" and ".join(f"n_{k}" for k in KEYS)).select(entries.columns)


def merged(target: DataFrame, source: DataFrame, order: str) -> DataFrame:
    """``target`` and what of ``source`` it lacks; duplicates within ``source`` come once."""
    return target.unionByName(first_of_each(absent(source, target), order))


def removed(entries: DataFrame, text: str) -> DataFrame:
    """Without the entries whose key, id or DOI the text is, or whose title holds it."""
    hit = (F.col("item_key") == text) | (F.col("entity_id") == text) | (bare_doi(F.col("doi")) == bare_doi(F.lit(text))) | F.contains(F.lower("title"), F.lit(text.lower()))
    return entries.where(~F.coalesce(hit, F.lit(False)))


def paper_ids(entries: DataFrame) -> DataFrame:
    """Every id under which an entry's paper may be indexed."""
    return entries.select(F.explode(F.array_compact(F.array("doi", "entity_id", "item_key"))).alias("paper_id")).distinct()


def status(entries: DataFrame, indexed: DataFrame) -> DataFrame:
    """Each entry with whether any of its ids is indexed."""
    rows = entries.withColumn("ids", F.array_compact(F.array("doi", "entity_id", "item_key")))
    found = rows.select("entry", F.explode("ids").alias("paper_id")).join(indexed.select("paper_id").distinct(), "paper_id").select("entry").distinct().withColumn("in_index", F.lit(True))
    return rows.join(found, "entry", "left").select("entry", F.coalesce("in_index", F.lit(False)).alias("in_index"), F.col("item_key").isNotNull().alias("in_library"))


def status_counts(status_rows: DataFrame) -> DataFrame:
    return status_rows.agg(F.count("*").alias("entries"), F.count_if("in_index").alias("in_index"), F.count_if("in_library").alias("in_library"))


def filled(library: DataFrame, catalog: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key of either side: the library's value of each column, else the catalog's."""
    rows = library.alias("l").join(catalog.alias("c"), key, "full")
    return rows.select(key, *[F.coalesce(F.col(f"l.{c}"), F.col(f"c.{c}")).alias(c) for c in columns])


def sync_plan(entries: DataFrame) -> DataFrame:
    """entry, action: what brings an entry into library and index."""
    actions = F.array_compact(F.array(F.when(F.col("item_key").isNull(), "create item"), F.when(~F.col("has_pdf"), "upload file"), F.when(~F.col("in_index"), "add to index")))
    return entries.select("entry", F.explode(actions).alias("action"))


def by_place(names: DataFrame, asked: str) -> DataFrame:
    """name, place of a selection by its 1-based place among sorted names, or by its name, whatever the case.

    A place is found by a top-k, a name's place by counting the names before it.
    """
    if asked.isdigit():
        place = int(asked)
        return names.orderBy("name").limit(place).orderBy(F.desc("name")).withColumn("place", F.lit(place)).limit(1) if 0 < place <= names.count() else names.limit(0).withColumn("place", F.lit(0))
    found = names.where(F.lower("name") == asked.lower())
    before = names.select(F.col("name").alias("other"))
    return found.join(before, F.col("other") <= F.col("name")).groupBy(*names.columns).agg(F.count("*").cast("int").alias("place"))
