"""From lines of a page to columns and blocks, and headings by their surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import looks_like_formula
from . import ordered

#: A block's line gap as a multiple of the page's, least ratio of fonts that parts blocks, share of a page that a spanning line covers.
GAP, FONT, SPANNING = 1.5, 1.3, 0.6


def upper_median(values: list[float]) -> float:
    """The sorted values' element at half."""
    return sorted(values)[len(values) // 2]


def line_blocks(lines: list[dict]) -> list[list[dict]]:
    """Lines (x1, y1, x2, y2, size, text) of one column in order, parted where the gap is wide, the lines don't overlap across, the font changes, or formulas begin or end.

    Lines of three characters or fewer never part a block.
    """
    if not lines:
        return []
    lines = sorted(lines, key=lambda x: (x["y1"], x["x1"]))
    gaps = [b["y1"] - a["y2"] for a, b in zip(lines, lines[1:])]
    usual = max(upper_median(gaps), 0.1) if gaps else 0.0
    formula = [looks_like_formula(x["text"]) for x in lines]
    out = [[lines[0]]]
    for k, (a, b, gap) in enumerate(zip(lines, lines[1:], gaps)):
        short = min(len(a["text"].strip()), len(b["text"].strip())) <= 3
        character = max(a["x2"] - a["x1"], b["x2"] - b["x1"]) / 40
        apart = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]) < -character
        font = max(a["size"], b["size"]) / max(min(a["size"], b["size"]), 0.1) > FONT
        maths = formula[k] != formula[k + 1]
        if (not short and (gap > GAP * usual or apart or font)) or maths:
            out.append([b])
        else:
            out[-1].append(b)
    return out


def columns(lines: list[dict], width: float, gap: float) -> list[list[dict]]:
    """Runs of lines in reading order: left and right of a gap at ``gap``, parted by lines that span it."""
    out, left, right = [], [], []
    for x in sorted(lines, key=lambda x: (x["y1"], x["x1"])):
        if x["x1"] < gap < x["x2"] and x["x2"] - x["x1"] > SPANNING * width:
            out += [c for c in (left, right) if c]
            out.append([x])
            left, right = [], []
        else:
            (left if (x["x1"] + x["x2"]) / 2 < gap else right).append(x)
    return out + [c for c in (left, right) if c]


def page_blocks(lines: DataFrame) -> DataFrame:
    """doc, page, block, n_lines, text of every page's lines; a null text is empty."""
    names = ["x1", "y1", "x2", "y2", "size", "text"]

    def run(*columns):
        blocks = line_blocks([dict(zip(names, x)) for x in zip(*(c.tolist() for c in columns))])
        return ((k, len(b), "\n".join(x["text"] for x in b)) for k, b in enumerate(blocks))

    rows = lines.select("doc", "page", *[F.col(c).cast("double") for c in names[:-1]], F.coalesce("text", F.lit("")).alias("text"))
    return ordered.in_pages(rows, ["y1", "x1", "text", "x2", "y2", "size"], run, "block int, n_lines int, text string")


def empty_headings(headings: DataFrame, content: DataFrame) -> DataFrame:
    """doc, seq of headings with no content below them on their page."""
    below = headings.select("doc", "page", "seq", F.col("y2").alias("h")).join(content.select("doc", "page", "y1"), ["doc", "page"]).where("y1 >= h").select("doc", "seq").distinct()
    return headings.select("doc", "seq").join(below, ["doc", "seq"], "left_anti")


def collapsed_front_matter(headings: DataFrame, front: list[str]) -> DataFrame:
    """Headings without those that stand below a front-matter heading, up to the next heading as high."""
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    top = F.when(F.col("depth") == 1, F.lower(F.trim("text")).isin(front))
    rows = headings.withColumn("in_front", F.last(top, True).over(w))
    return rows.where((F.col("depth") == 1) | ~F.coalesce("in_front", F.lit(False))).drop("in_front")


def contents_anchors(toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, seq, block of the first block on an entry's page that opens with its title."""
    key = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    rows = toc.select("doc", "seq", "page", key("title").alias("key")).where("key <> ''").join(blocks.select("doc", "page", "block", key("text").alias("body")), ["doc", "page"])
    return rows.where(F.col("body").startswith(F.col("key"))).groupBy("doc", "seq").agg(F.min("block").alias("block"))
