"""Browsing the document index: lookups, positions, neighbours, outlines, listings.

Every query is one pass of grouped or windowed DataFrame work over the chunk and exhibit tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview

SECTION = ["paper_id", "chapter_idx", "section_idx"]
ORDER = [*SECTION, "chunk_idx"]


def resolve_paper(chunks: DataFrame, asked: str) -> DataFrame:
    """paper_id, title, rank of the paper meant: its exact id, else the first whose title holds the text, whatever the case."""
    articles = chunks.select("paper_id", "title").distinct()
    rank = F.when(F.col("paper_id") == asked, 0).when(F.contains(F.lower("title"), F.lit(asked.lower())), 1)
    return articles.withColumn("rank", rank).where("rank is not null").orderBy("rank", "paper_id").limit(1)


def is_indexed(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """paper_id, indexed for every asked id."""
    known = chunks.select("paper_id").distinct().withColumn("indexed", F.lit(True))
    return ids.join(known, "paper_id", "left").select("paper_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ids and previews of the ones before and after it in its section.

    A neighbour that is an equation is shown with the one beyond it.
    """
    w = Window.partitionBy(*SECTION).orderBy("chunk_idx")
    near, far = (lambda k: F.lag("text", k).over(w)), (lambda k: F.lead("text", k).over(w))
    before = F.when(F.lag("block_type").over(w) == "equation", F.concat_ws(" ", near(2), near(1))).otherwise(preview(near(1)))
    after = F.when(F.lead("block_type").over(w) == "equation", F.concat_ws(" ", far(1), far(2))).otherwise(preview(far(1)))
    return chunks.select(*ORDER, "chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), before.alias("prev_preview"), after.alias("next_preview"))


def positions(chunks: DataFrame) -> DataFrame:
    """Each chunk's place: chunks of its section, sections of its chapter, chapters of its paper, whether it is first or last.

    Counts of sections and chapters come from grouped counts and join back on their keys.
    """
    sections = chunks.groupBy(*SECTION).agg(F.count("*").alias("chunks_in_section"), F.min("chunk_idx").alias("low"), F.max("chunk_idx").alias("high"))
    chapters = sections.groupBy("paper_id", "chapter_idx").agg(F.count("*").alias("sections_in_chapter"))
    articles = chapters.groupBy("paper_id").agg(F.count("*").alias("chapters_in_paper"))
    rows = chunks.select(*ORDER, "chunk_id").join(sections, SECTION).join(chapters, ["paper_id", "chapter_idx"]).join(articles, "paper_id")
    return rows.withColumns({"is_first": F.col("chunk_idx") == F.col("low"), "is_last": F.col("chunk_idx") == F.col("high")}).drop("low", "high")


def list_articles(chunks: DataFrame, exhibits: DataFrame, author: Column | None = None, by: str = "year", limit: int | None = None) -> DataFrame:
    """One row per paper: its first chunk's metadata, chunks and exhibits; by year, newest first and unknown last, or by title."""
    first = lambda c: F.min_by(c, F.struct("chapter_idx", "section_idx", "chunk_idx")).alias(c)
    rows = chunks.groupBy("paper_id").agg(*[first(c) for c in ("title", "year", "venue", "authors", "tags")], F.count("*").alias("chunk_count"))
    counts = exhibits.groupBy("paper_id").agg(F.count("*").alias("exhibit_count"))
    rows = rows.join(counts, "paper_id", "left").withColumn("exhibit_count", F.coalesce("exhibit_count", F.lit(0).cast("long")))
    rows = rows if author is None else rows.where(author)
    rows = rows.orderBy(F.desc_nulls_last("year"), "paper_id") if by == "year" else rows.orderBy("title", "paper_id")
    return rows if limit is None else rows.limit(limit)


def list_tags(chunks: DataFrame) -> DataFrame:
    """tag, articles: most articles first."""
    return chunks.select("paper_id", F.explode("tags").alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "tag")


def list_sections(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(*SECTION).agg(F.min_by("section_title", "chunk_idx").alias("section_title"), F.count("*").alias("chunk_count")).orderBy(*SECTION)


def list_chapters(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id", "chapter_idx").agg(F.countDistinct("section_idx").alias("section_count"), F.count("*").alias("chunk_count")).orderBy("paper_id", "chapter_idx")


def outline(chunks: DataFrame, exhibits: DataFrame, paper: str) -> DataFrame:
    """chapter_idx, sections (as ``index:chunks`` in order), chunk_count, exhibit_count of one paper."""
    sections = chunks.where(F.col("paper_id") == paper).groupBy("chapter_idx", "section_idx").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_idx", "n"))), lambda s: F.concat_ws(":", s["section_idx"], s["n"])), ",")
    rows = sections.groupBy("chapter_idx").agg(listed.alias("sections"), F.sum("n").alias("chunk_count"))
    counts = exhibits.where(F.col("paper_id") == paper).groupBy("chapter_idx").agg(F.count("*").alias("exhibit_count"))
    return rows.join(counts, "chapter_idx", "left").withColumn("exhibit_count", F.coalesce("exhibit_count", F.lit(0).cast("long"))).orderBy("chapter_idx")


def outline_rollup(chunks: DataFrame) -> DataFrame:
    """Chunk counts of every section, chapter and paper at once."""
    return chunks.rollup("paper_id", "chapter_idx").agg(F.count("*").alias("chunk_count"), F.countDistinct("section_idx").alias("section_count"))


def get_work(chunks: DataFrame, exhibits: DataFrame, paper: str) -> DataFrame:
    return list_articles(chunks.where(F.col("paper_id") == paper), exhibits.where(F.col("paper_id") == paper))


def get_section(chunks: DataFrame, paper: str, chapter: int, section: int) -> DataFrame:
    """Rows of a section in order, with its total."""
    rows = chunks.where((F.col("paper_id") == paper) & (F.col("chapter_idx") == chapter) & (F.col("section_idx") == section))
    return rows.select("chunk_id", "chunk_idx", "text", F.count("*").over(Window.partitionBy(*SECTION)).alias("total")).orderBy("chunk_idx")


def get_chapter(chunks: DataFrame, paper: str, chapter: int) -> DataFrame:
    """section_idx, chunk_ids, exhibit_ids (distinct, as first seen) of a chapter's sections."""
    rows = chunks.where((F.col("paper_id") == paper) & (F.col("chapter_idx") == chapter))
    listed = F.array_sort(F.collect_list(F.struct("chunk_idx", "chunk_id", "exhibit_ids")))
    rows = rows.groupBy("section_idx").agg(listed.alias("x"))
    return rows.select("section_idx", F.array_join(F.transform("x", lambda c: c["chunk_id"]), ",").alias("chunk_ids"), F.array_join(F.array_distinct(F.flatten(F.transform("x", lambda c: c["exhibit_ids"]))), ",").alias("exhibit_ids")).orderBy("section_idx")


def referenced_exhibits(chunks: DataFrame, exhibits: DataFrame) -> DataFrame:
    """chunk_id, exhibit_id, caption of the exhibits that chunks refer to."""
    refs = chunks.select("chunk_id", F.explode("exhibit_ids").alias("exhibit_id"))
    return refs.join(exhibits.select("exhibit_id", "caption"), "exhibit_id")


def referenced_by(chunks: DataFrame) -> DataFrame:
    """exhibit_id, chunk_ids that refer to it: the lookup the other way round."""
    refs = chunks.select("chunk_id", F.explode("exhibit_ids").alias("exhibit_id"))
    return refs.groupBy("exhibit_id").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), ",").alias("chunk_ids"))


def list_chunks(chunks: DataFrame, limit: int = 50) -> DataFrame:
    return chunks.select(*ORDER, "chunk_id", preview(F.col("text")).alias("preview")).orderBy(*ORDER).limit(limit)


def get_exhibit(exhibits: DataFrame, exhibit: str) -> DataFrame:
    """One exhibit's record; no row if there is none."""
    return exhibits.where(F.col("exhibit_id") == exhibit).limit(1)


def available(chunks: DataFrame) -> DataFrame:
    """paper_id, title of all that is indexed: what is listed where ``resolve_paper`` finds nothing."""
    return chunks.groupBy("paper_id").agg(F.min_by("title", F.struct("chapter_idx", "section_idx", "chunk_idx")).alias("title"))
