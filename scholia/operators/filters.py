"""Predicates over the index tables, each None when it asks for nothing, and their conjunction."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids up to which a list is an IN predicate; longer lists join.
MOST_LITERALS = 500


def articles(ids: list[str] | None, strict: bool = False) -> Column | None:
    """Rows of the named articles.  An empty list asks for nothing; ``strict``: for no row."""
    if ids is None or not ids and not strict:
        return None
    return F.col("paper_id").isin(list(ids))


def only_articles(df: DataFrame, ids: list[str]) -> DataFrame:
    """As ``articles``; a long list becomes a semi-join."""
    if len(ids) <= MOST_LITERALS:
        return matching(df, articles(ids))
    return df.join(df.sparkSession.createDataFrame([(x,) for x in set(ids)], "paper_id string"), "paper_id", "left_semi")


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def years(least: int | None, most: int | None) -> Column | None:
    """Both ends included; a null year fails."""
    parts = [F.col("year") >= least] if least is not None else []
    parts += [F.col("year") <= most] if most is not None else []
    return reduce(and_, parts) if parts else None


def any_tag(tags: list[str]) -> Column | None:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else None


def any_author(names: list[str]) -> Column | None:
    """An author's name holds one of ``names``, whatever the case."""
    if not names:
        return None
    return F.exists("authors", lambda a: reduce(lambda x, y: x | y, [F.contains(F.lower(a), F.lit(n.lower())) for n in names]))


def scope(paper: str | None, chapter: int | None, section: int | None) -> list[Column | None]:
    """A section needs its chapter and a chapter its paper."""
    if section is not None and chapter is None:
        raise ValueError("a section needs its chapter")
    if chapter is not None and paper is None:
        raise ValueError("a chapter needs its paper")
    return [articles([paper]) if paper is not None else None, equals("chapter_idx", chapter), equals("section_idx", section)]


def matching(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows that meet every predicate asked for."""
    asked = [p for p in predicates if p is not None]
    return df.where(reduce(and_, asked)) if asked else df
