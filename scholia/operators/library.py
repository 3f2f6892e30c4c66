"""Library items: tag and type expressions, scopes, attachments, version-based sync."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_doi

#: Link modes and content types of attachments.
STORED, PDF, ANNOTATABLE = ["imported_file", "imported_url"], "application/pdf", ["application/pdf", "application/epub+zip", "text/html"]
MOST_KEYS = 50


def expression(text: str, one) -> Column:
    """``a || b`` is either, a leading ``-`` is not: ``one(name)`` tests a name."""
    parts = [p.strip() for p in text.split("||")]
    return reduce(or_, [~one(p[1:].strip()) if p.startswith("-") else one(p.removeprefix("\\")) for p in parts if p])


def tagged(*expressions: str) -> Column:
    """Items that meet every tag expression."""
    return reduce(and_, [expression(e, lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))) for e in expressions] or [F.lit(True)])


def of_type(text: str) -> Column:
    return expression(text, lambda t: F.col("item_type") == t)


def quick_search(text: str, everything: bool = False) -> Column:
    """Title, creators and year hold the text, whatever the case; ``everything``: any field."""
    columns = ["title", "creators", "year", *(["abstract", "note"] if everything else [])]
    return F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(text.lower()))


def keyed(keys: list[str]) -> Column:
    if len(keys) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys")
    return F.col("item_key").isin(keys)


def scoped(items: DataFrame, scope: str, key: str | None = None) -> DataFrame:
    """top, trash, collection, collection top, children: the rows of a listing."""
    alive, top = ~F.coalesce(F.col("deleted"), F.lit(False)), F.col("parent_key").isNull()
    tests = {"all": alive, "top": alive & top, "trash": ~alive, "children": alive & (F.col("parent_key") == key), "collection": alive & F.array_contains("collections", key), "collection top": alive & top & F.array_contains("collections", key)}
    return items.where(tests[scope])


def since(rows: DataFrame, version: int) -> DataFrame:
    """Rows changed after a version."""
    return rows.where(F.col("version") > version)


def checkpoint(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("version").alias("version"))


def synced(held: DataFrame, changed: DataFrame, gone: DataFrame, key: str = "item_key") -> DataFrame:
    """What a library holds after a sync: newer rows replace held ones, tombstones take rows away."""
    fresh = changed.join(gone.select(key), key, "left_anti")
    return held.join(gone.select(key).unionByName(changed.select(key)).distinct(), key, "left_anti").unionByName(fresh)


def written_if_current(held: DataFrame, writes: DataFrame, key: str = "item_key") -> DataFrame:
    """Each write's outcome: created, updated, or a conflict where the expected version isn't the held one."""
    rows = writes.join(held.select(key, F.col("version").alias("held_version")), key, "left")
    outcome = F.when(F.col("held_version").isNull() & (F.coalesce("expected", F.lit(0)) == 0), "created").when(F.col("held_version") == F.col("expected"), "updated").otherwise("conflict")
    return rows.select(key, outcome.alias("outcome"))


def is_pdf() -> Column:
    return (F.col("content_type") == PDF) & F.col("link_mode").isin(STORED)


def annotations_of(items: DataFrame) -> DataFrame:
    """work, attachment, annotation keys: two steps down the item tree, over attachments that can hold annotations."""
    works = items.where("parent_key is null").select(F.col("item_key").alias("work_key"))
    held = items.where(F.col("content_type").isin(ANNOTATABLE)).select(F.col("item_key").alias("attachment_key"), F.col("parent_key").alias("work_key"))
    notes = items.where("item_type = 'annotation'").select(F.col("item_key").alias("annotation_key"), F.col("parent_key").alias("attachment_key"))
    return works.join(held, "work_key").join(notes, "attachment_key")


def linked_works(works: DataFrame, items: DataFrame) -> DataFrame:
    """Catalog works and the library items with the same DOI, whatever its form, and whether a child is a stored PDF."""
    pdf = items.where(is_pdf()).select(F.col("parent_key").alias("item_key")).distinct().withColumn("has_pdf", F.lit(True))
    mine = items.where("parent_key is null and doi is not null").select("item_key", bare_doi(F.col("doi")).alias("bare"))
    rows = works.withColumn("bare", bare_doi(F.col("doi"))).join(mine, "bare").join(pdf, "item_key", "left")
    return rows.withColumn("has_pdf", F.coalesce("has_pdf", F.lit(False)))


def item_collections(items: DataFrame, collections: DataFrame) -> DataFrame:
    """item_key, collection names in order of key."""
    rows = items.select("item_key", F.explode("collections").alias("collection_key")).join(collections, "collection_key")
    return rows.groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("collection_key", "name"))), lambda c: c["name"]), "; ").alias("names"))


#: Most rows of a listing.
MOST_ROWS = 100


def listing(items: DataFrame, sort: str, descending: bool = False, limit: int = 25, start: int = 0) -> DataFrame:
    """A page of items by a field, ties by key; 1 to 100 rows."""
    if not 1 <= limit <= MOST_ROWS or start < 0:
        raise ValueError("a listing has 1 to 100 rows")
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return items.orderBy(order, "item_key").offset(start).limit(limit)


def found_by_key_or_name(rows: DataFrame, asked: str, key: str, name: str) -> DataFrame:
    """The row with the key, else the first, by key, whose name holds the text."""
    rank = F.when(F.col(key) == asked, 0).when(F.contains(F.lower(name), F.lit(asked.lower())), 1)
    return rows.withColumn("rank", rank).where("rank is not null").orderBy("rank", key).limit(1)


def searched_tags(items: DataFrame, text: str, mode: str = "contains") -> DataFrame:
    """tag, items: tags that hold or begin with the text."""
    rows = items.select("item_key", F.explode("tags").alias("tag")).distinct()
    hit = F.startswith(F.lower("tag"), F.lit(text.lower())) if mode == "startsWith" else F.contains(F.lower("tag"), F.lit(text.lower()))
    return rows.where(hit).groupBy("tag").agg(F.count("*").alias("items"))


def fulltext_versions(rows: DataFrame, version: int) -> DataFrame:
    """item_key, version of full texts newer than a version: the latest of each."""
    return rows.where(F.col("version") > version).groupBy("item_key").agg(F.max("version").alias("version"))


def write_outcomes(responses: DataFrame) -> DataFrame:
    """Responses to writes (successful, failed: maps, the former to objects as JSON) with whether all is well and the keys that were written."""
    keys = F.filter(F.transform(F.map_values("successful"), lambda v: F.get_json_object(v, "$.key")), lambda k: k.isNotNull())
    return responses.withColumns({"is_ok": F.coalesce(F.size("failed"), F.lit(0)) <= 0, "keys": F.coalesce(keys, F.array().cast("array<string>"))})


def item_uri(key: Column) -> Column:
    """The address by which the library's own program opens an item."""
    return F.concat(F.lit("zotero://select/library/items/"), key)
