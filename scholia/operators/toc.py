"""Tables of contents: lines to entries, page offsets by vote, ranges of sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered

#: Words that name front and back matter.
FRONT = "preface foreword acknowledgments acknowledgements dedication contents introduction prologue abstract notation abbreviations"
BACK = "references bibliography index glossary appendices afterword epilogue notes"
_LINE = re.compile(r"^(?P<title>.*?)(?:\s*(?:\.\s?){3,}\s*|\s{2,}|\s+)(?P<page>\d{1,4}|[ivxlc]{1,7})\s*$")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def page_value(label: str) -> int | None:
    """A printed page as a number, Roman ones negative."""
    if label.isdigit():
        return int(label) if 1 <= int(label) <= 9999 else None
    if re.fullmatch(r"c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", label) and label:
        n = [_ROMAN[c] for c in label]
        return -sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
    return None


def kind_of(title: str) -> tuple[str, int]:
    """(kind, depth) of an entry by its title, the first rule that fits."""
    low = title.strip().lower()
    if re.match(r"(?:chapter)\s+[\divxlc]+", low):
        return "chapter", 1
    if re.match(r"part\s+[\divxlc]+\b", low):
        return "part", 0
    if m := re.match(r"(\d+(?:\.\d+)+)\.?\s", low):
        return "section", m[1].count(".") + 1
    if m := re.match(r"[a-z]((?:\.\d+)+)\s", low):
        return "appendix section", m[1].count(".") + 1
    if re.match(r"\d+\.?\s+\S", low):
        return "chapter", 1
    if low.startswith("appendix"):
        return "appendix", 1
    if low.split(" ")[0] in FRONT.split():
        return "front", 1
    if low.split(" ")[0] in BACK.split():
        return "back", 1
    return "unknown", 1


def parse(lines: list[str]) -> list[tuple]:
    """(depth, title, page_label, page_value, kind) of a contents page's lines.

    A line without a page is held and opens the next one's title; parts need none; fewer than three
    entries are no contents.
    """
    out, held, seen = [], [], set()
    for line in lines:
        line = line.strip()
        if not line or line.lower() in ("contents", "table of contents"):
            continue
        m = _LINE.match(line)
        value = page_value(m["page"]) if m else None
        if value is None:
            if kind_of(line)[0] == "part":
                out.append((0, line, None, None, "part"))
            else:
                held.append(line)
            continue
        own = m["title"].strip(" .")
        title = own if kind_of(own)[0] != "unknown" else " ".join([*held, own]).strip()
        held = []
        kind, depth = kind_of(title)
        if title and (title, m["page"]) not in seen:
            seen.add((title, m["page"]))
            out.append((depth, title, m["page"], value, kind))
    return out if sum(e[3] is not None for e in out) >= 3 else []


def entries(pages: DataFrame) -> DataFrame:
    """doc, seq and the entries of each document's contents lines (doc, seq, text)."""

    def fold(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = parse(pdf.sort_values("seq").text.tolist())
        df = pd.DataFrame(rows, columns=["depth", "title", "page_label", "page_value", "kind"]).astype({"page_value": "Int32"})
        df.insert(0, "seq", range(len(df)))
        df.insert(0, "doc", key[0])
        return df

    return pages.groupBy("doc").applyInPandas(fold, "doc string, seq int, depth int, title string, page_label string, page_value int, kind string")


def title_key(title: Column) -> Column:
    """Without numbering and marks, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(title)), r"^(?:chapter\s+)?(?:\d+(?:\.\d+)*|[ivxlc]+\.)\.?\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def page_offsets(toc: DataFrame, headings: DataFrame) -> DataFrame:
    """doc, offset: the difference between page index and printed page that most title matches give; ties by the smaller."""
    a = toc.where("page_value > 0").select("doc", title_key(F.col("title")).alias("key"), "page_value").where("key <> ''")
    b = headings.select("doc", title_key(F.col("text")).alias("key"), "page").distinct()
    votes = a.join(b, ["doc", "key"]).groupBy("doc", (F.col("page") - F.col("page_value")).alias("offset")).agg(F.count("*").alias("votes")).where("offset >= 0")
    w = Window.partitionBy("doc").orderBy(F.desc("votes"), "offset")
    return votes.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def section_ranges(toc: DataFrame, last_page: int) -> DataFrame:
    """doc, seq, page_from, page_to of each entry: up to the next of the same or a smaller depth, in one pass in order."""
    rows = ordered.nested(toc.select("doc", "seq", "depth", F.col("page_value").alias("value"))).withColumnRenamed("value", "page_from")
    return rows.select("doc", "seq", "page_from", F.coalesce(F.greatest(F.col("next_value") - 1, F.col("page_from")), F.lit(last_page)).alias("page_to"))


def rendered(rows: DataFrame) -> DataFrame:
    """doc, markdown: a contents listing, indented by depth, pages behind the titles."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0))), F.lit("- "), F.col("title"), F.coalesce(F.concat(F.lit(" ("), F.col("page_label"), F.lit(")")), F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("markdown"))
